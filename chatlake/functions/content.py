"""Expressions over a message's parsed content blocks.

``blocks`` is ``array<struct<type, text, thinking, id, name, input,
tool_use_id, is_error, content, content_missing, items: array<struct<type,
text>>>>`` as built by :func:`chatlake.operators.parse.parse_lines`: a tool
result's ``content`` is set when it is a string, ``items`` when it is a list. All of it stays in higher-order
functions, so the parse stage keeps whole-stage codegen and needs no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANY_LENGTH, TOOL_INPUT_DDL
from .text import MAX_TOOL_RESULT_SNIPPET, col, json_truthy, nonempty


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def _snippet(s: Column) -> Column:
    return F.concat(F.lit("[tool_result: "),
                    F.substring(F.coalesce(s, F.lit("")), 1, MAX_TOOL_RESULT_SNIPPET),
                    F.lit("]"))


def block_texts(blocks) -> Column:
    """F3 (list case): text blocks plus ``[tool_result: …]`` snippets, in order."""
    def one(b):
        # list -> one snippet per text item; string -> one snippet; a missing
        # content counts as ''; JSON null or any other type adds nothing.
        result_parts = (
            F.when(b["items"].isNotNull(),
                   F.transform(F.filter(b["items"], lambda i: i["type"] == "text"),
                               lambda i: _snippet(i["text"])))
            .when(b["content"].isNotNull(), F.array(_snippet(b["content"])))
            .when(b["content_missing"], F.array(_snippet(F.lit(""))))
            .otherwise(_empty_strings()))
        return (F.when(b["type"] == "text", F.array(F.coalesce(b["text"], F.lit(""))))
                .when(b["type"] == "tool_result", result_parts)
                .otherwise(_empty_strings()))
    return F.array_join(F.flatten(F.transform(col(blocks), one)), "\n")


def content_text(content_string, blocks) -> Column:
    """the string content as is, else the joined block texts, else ''."""
    return (F.when(col(blocks).isNotNull(), block_texts(blocks))
            .otherwise(F.coalesce(col(content_string), F.lit(""))))


def thinking_text(blocks) -> Column:
    """thinking blocks joined by a separator; NULL when there is none."""
    thoughts = F.transform(F.filter(col(blocks), lambda b: b["type"] == "thinking"),
                           lambda b: F.coalesce(b["thinking"], F.lit("")))
    return F.when(F.size(thoughts) > 0, F.array_join(thoughts, "\n---\n"))


def has_thinking(blocks) -> Column:
    """true when any thinking block exists (even an empty one)."""
    return F.coalesce(F.exists(col(blocks), lambda b: b["type"] == "thinking"), F.lit(False))


def tool_uses(blocks) -> Column:
    """the tool_use blocks of a message: id, name, raw input JSON, and the
    input fields the tables use, read once here at parse time. ``path`` is
    the first non-empty of file_path, path, notebook_path."""
    def one(b):
        inp = F.from_json(b["input"], TOOL_INPUT_DDL, {"mode": "PERMISSIVE", **ANY_LENGTH})
        return F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("input"),
                        first_truthy(inp["file_path"], inp["path"], inp["notebook_path"]).alias("path"),
                        inp["command"].alias("command"), inp["description"].alias("description"))
    return F.transform(F.filter(col(blocks), lambda b: b["type"] == "tool_use"), one)


def tool_results(blocks) -> Column:
    """(tool_use_id, is_error) of the tool_result blocks with a truthy id."""
    res = F.filter(col(blocks), lambda b: (b["type"] == "tool_result") & (nonempty(b["tool_use_id"]).isNotNull()))
    return F.transform(res, lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"),
                                                json_truthy(b["is_error"]).alias("is_error")))


def first_truthy(*cols) -> Column:
    """Python ``a or b or c``: the first non-empty value, else the last one."""
    cs = [col(c) for c in cols]
    return F.coalesce(*[nonempty(c) for c in cs[:-1]], cs[-1])
