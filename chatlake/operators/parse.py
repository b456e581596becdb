"""Transcript lines -> typed entries (no UDF, no inference).

``parse_lines`` is the one contract every source meets: disk scans and
synthesised corpora both arrive as the ``LINES`` schema, so the driver's
tables exercise exactly the code real files go through.

Parsing recipe (why it is shaped like this):

* The envelope is read with an explicit schema whose polymorphic or numeric
  fields are STRING; a type mismatch inside ``from_json`` turns the whole
  record corrupt, so typing happens afterwards with ``try_cast``.
* ``message.content`` is a string or an array of blocks. It is read as typed
  blocks, else as text, and only where that text begins with ``[`` again with
  ``content array<string>`` (each element stays raw JSON). Content that cannot
  be copied as text, as it is nested too deep, is read without its tool
  inputs' text and named ``unread_input`` in the quarantine, beside its rows.
  These reads sit in lazy CASE branches, each only where it is needed.
* ``from_json`` stops after the first object of a line. Whether the line ends
  there is told by a read that skips all fields, with a mark behind the line.
* A numeric ``timestamp`` is told from a numeric-looking *string* by a
  second typed read, again only for numeric-looking values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import content as C
from ..functions.commands import command_invocation
from ..functions.text import json_truthy, nonempty
from ..functions.timestamps import NUMERIC_PATTERN, parse_timestamp

JSON_OPTS = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE", **schemas.ANY_LENGTH}
# Any option keeps Catalyst from splitting one from_json into one parse per
# extracted field (it only prunes schemas of option-less JSON reads).
ONE_PARSE = {"mode": "PERMISSIVE", **schemas.ANY_LENGTH}


BLOCK_FIELDS = ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "is_error")


def _with_content(b, content, content_missing, items):
    """One block: its fields, a tool result's content when it is a string,
    whether that content key is missing, and its items when it is a list."""
    return F.struct(*[b[n].alias(n) for n in BLOCK_FIELDS], content.alias("content"),
                    content_missing.alias("content_missing"), items.alias("items"))


def _typed_block(b):
    """A block from the typed read. A tool result's ``content`` is read as
    VARIANT, which keeps its JSON type: a string, a list of items, JSON null
    and a missing key are told apart exactly (D7: an object inside a list
    result with a repeated key reads as a missing content)."""
    c = b["content"]
    is_result = b["type"] == "tool_result"
    as_string = F.when(is_result & (F.schema_of_variant(c) == "STRING"), F.try_variant_get(c, "$", "string"))
    items = F.when(is_result, F.transform(
        F.try_variant_get(c, "$", "array<variant>"),
        lambda e: F.struct(F.try_variant_get(e, "$.type", "string").alias("type"),
                           F.try_variant_get(e, "$.text", "string").alias("text"))))
    return _with_content(b, as_string, c.isNull(), items)


def _raw_block(raw):
    """Fallback: a block kept as raw JSON text (for arrays the typed read rejects)."""
    b = F.from_json(raw, schemas.BLOCK_DDL, ONE_PARSE)
    items = F.when((b["type"] == "tool_result") & b["content"].startswith("["),
                   F.from_json(raw, schemas.RESULT_ITEMS_DDL, ONE_PARSE)["content"])
    return _with_content(b, F.when(items.isNull(), b["content"]), b["content"].isNull(), items)


END_KEY = "chatlake_end"
_END = f'{{"{END_KEY}":1}}'


def _one_value(v, elements: str):
    """``v`` and a mark as the two elements of a JSON array (NULL if they are not): text behind the first
    value of ``v`` makes the array invalid, or one of another length."""
    both = F.from_json(F.concat(F.lit("["), v, F.lit("," + _END + "]")), elements, ONE_PARSE)
    return F.when(F.size(both) == 2, both)


def ends_after_object(v):
    """Whether the line is one JSON object and nothing else. No field is kept, so this only walks the text."""
    marked = F.coalesce(_one_value(v, f"array<struct<{END_KEY}:int>>")[1][END_KEY] == 1, F.lit(False))
    # a line that has the mark's name itself is walked in two frames, which no text behind an object fits both
    framed = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v struct<_:string>, _corrupt_record string", JSON_OPTS)
    listed = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<struct<_:string>>", ONE_PARSE)
    return F.when(v.contains(END_KEY), framed["_corrupt_record"].isNull() & F.coalesce(F.size(listed) == 1, F.lit(False))).otherwise(marked)


def _bad_reason():
    """Why a line is not an entry (evaluated for those lines only): blank,
    valid JSON that is not an object ('not_object', a file error for the
    reference, Q9), an object with more text behind it ('trailing_content'),
    an object with a value of a type that no entry has, such as a message that is
    a number ('unread_object'), or invalid JSON ('malformed_json', skipped silently)."""
    v = F.col("value")
    is_object = F.regexp_replace(v, r"(?U)^\s+", "").startswith("{")
    framed = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("," + _END[1:])), f"{END_KEY} int", ONE_PARSE)
    valid = F.when(is_object, ends_after_object(v)).otherwise(F.coalesce(framed[END_KEY] == 1, F.lit(False)))
    first = F.from_json(v, "_ string, _corrupt_record string", JSON_OPTS)
    return (F.when(v.rlike(r"(?U)^\s*$"), F.lit("blank"))
            .when(valid, F.when(is_object, F.lit("unread_object")).otherwise(F.lit("not_object")))
            .when(is_object & first["_corrupt_record"].isNull(), F.lit("trailing_content"))
            .otherwise(F.lit("malformed_json")))


def _is_entry(e):
    """Whether the line is one JSON object that the envelope reads."""
    return F.when(e.isNotNull() & e["_corrupt_record"].isNull(), ends_after_object(F.col("value"))).otherwise(F.lit(False))


def _envelope():
    return F.from_json("value", schemas.ENVELOPE_DDL, JSON_OPTS)


def quarantine(lines: DataFrame) -> DataFrame:
    """D-1: lines the parse skips (blank, or not one JSON object), with a reason."""
    e = _envelope()
    reason = F.when(~_is_entry(e), _bad_reason())
    return (lines.select("file_path", "session_id", "line_num", reason.alias("reason"), "value")
            .filter(F.col("reason").isNotNull()))


def parse_lines(lines: DataFrame, with_quarantine: bool = False):
    """Lines -> entries: one row per parsed JSON object, typed.

    Entries keep every entry type (A1/A3 need system and other types too);
    message fields are set for user/assistant entries only.
    """
    # A blank or malformed line parses to a NULL envelope and so adds
    # nothing to any table. No filter here on purpose: Catalyst would push
    # it below the projection and parse every line twice.
    raw = F.col("e_raw")
    valid = lines.withColumn("e_raw", _envelope()).withColumn("is_entry", _is_entry(raw)).select(
        "*", F.when(F.col("is_entry"), raw).alias("e"),
        F.when(~F.col("is_entry"), _bad_reason()).alias("parse_error"),
    ).drop("e_raw", "is_entry")
    e = F.col("e")
    etype = e["type"]
    is_msg = etype.isin("user", "assistant")
    ts_raw = e["timestamp"]
    ts_num = F.when(ts_raw.rlike(NUMERIC_PATTERN),
                    F.from_json("value", "timestamp double", ONE_PARSE)["timestamp"])
    msg = e["message"]
    typed = F.when(is_msg, F.from_json("value", schemas.CONTENT_BLOCKS_DDL, ONE_PARSE)["message"]["content"])
    usage_raw = F.when(is_msg, msg["usage"])
    out = valid.select(
        *schemas.FILE_COLS, "line_num",
        etype.alias("type"),
        parse_timestamp(ts_raw, ts_num).alias("ts"),
        e["uuid"].alias("uuid"), e["parentUuid"].alias("parent_uuid"),
        json_truthy(e["isSidechain"]).alias("is_sidechain"),
        e["gitBranch"].alias("git_branch"), e["cwd"].alias("cwd"),
        e["version"].alias("version"), e["slug"].alias("slug"), e["agentId"].alias("agent_id"),
        F.when((etype == "system") & (e["subtype"] == "turn_duration"),
               e["durationMs"].try_cast("double")).alias("turn_duration_ms"),
        is_msg.alias("is_message"),
        F.when(is_msg, F.coalesce(nonempty(msg["role"]), etype)).alias("role"),
        F.when(is_msg, msg["model"]).alias("model"),
        F.when(is_msg, msg["id"]).alias("api_message_id"),
        F.when(is_msg, msg["stop_reason"]).alias("stop_reason"),
        usage_raw.alias("usage_raw"),
        typed.alias("typed"),
        "value", "parse_error",
    )
    # Arrays the typed read rejects (e.g. a bare string element) take the
    # exact, slower path: elements as raw JSON, parsed one by one.
    untyped = F.col("is_message") & F.col("typed").isNull()
    out = out.withColumn("content_raw", F.when(
        untyped, F.from_json("value", schemas.CONTENT_STRING_DDL, ONE_PARSE)["message"]["content"]))
    out = out.withColumn("content_arr", F.when(
        untyped & F.col("content_raw").startswith("["),
        F.transform(F.from_json("value", schemas.CONTENT_ARRAY_DDL, ONE_PARSE)["message"]["content"],
                    _raw_block)))
    out = out.withColumn("deep", F.when(
        untyped & F.col("content_raw").isNull(),
        F.transform(F.from_json("value", schemas.CONTENT_DEEP_DDL, ONE_PARSE)["message"]["content"],
                    lambda b: _typed_block(b.withField("input", F.to_json(b["input"]))))))
    # Second stage: string content (only when not an array), blocks.
    out = out.select(
        "*",
        F.when(F.col("typed").isNull() & F.col("content_arr").isNull(), F.col("content_raw")).alias("content_str"),
        F.coalesce(F.transform("typed", _typed_block), F.col("content_arr"), F.col("deep")).alias("blocks"),
        F.coalesce("parse_error", F.when(F.col("deep").isNotNull(), F.lit("unread_input"))).alias("error"),
        F.from_json("usage_raw", schemas.USAGE_DDL, ONE_PARSE).alias("u"),
    ).drop("content_arr", "typed", "content_raw", "deep", "parse_error").withColumnRenamed("error", "parse_error")
    out = out.withColumn("text", F.when(F.col("is_message"), C.content_text("content_str", "blocks")))
    usage_present = F.col("usage_raw").isNotNull() & (F.col("usage_raw") != "{}")

    def tok(name):
        return F.when(usage_present, F.coalesce(F.col("u")[name].try_cast("long"), F.lit(0)))

    text = F.col("text")
    is_asst = F.col("role") == "assistant"
    entries = out.select(
        *schemas.FILE_COLS, "line_num", "type", "ts", "uuid", "parent_uuid", "is_sidechain",
        "git_branch", "cwd", "version", "slug", "agent_id", "turn_duration_ms",
        "is_message", "role", "model", "api_message_id", "stop_reason",
        usage_present.alias("usage_present"),
        tok("input_tokens").alias("input_tokens"),
        tok("output_tokens").alias("output_tokens"),
        tok("cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        tok("cache_read_input_tokens").alias("cache_read_input_tokens"),
        F.when(usage_present, F.col("u")["service_tier"]).alias("service_tier"),
        F.when(usage_present, F.col("u")["inference_geo"]).alias("inference_geo"),
        "text",
        F.when(is_asst, C.thinking_text("blocks")).alias("thinking_text"),
        F.when(is_asst, C.has_thinking("blocks")).otherwise(F.lit(False)).alias("has_thinking"),
        # F8 runs on the untruncated text of user messages (Q6).
        F.when(F.col("role") == "user", command_invocation(text)).alias("command"),
        F.when(is_asst, C.tool_uses("blocks")).alias("tool_uses"),
        F.when(F.col("role") == "user", C.tool_results("blocks")).alias("tool_results"),
        # D-1: skipped lines keep their reason and text (NULL on good lines).
        "parse_error", F.when(F.col("parse_error").isNotNull(), F.col("value")).alias("bad_value"),
    )
    return (entries, quarantine(lines)) if with_quarantine else entries


def quarantine_of(entries: DataFrame) -> DataFrame:
    """D-1 from parsed entries (no second parse of the raw lines)."""
    return entries.filter(F.col("parse_error").isNotNull()).select(
        "file_path", "session_id", "line_num", F.col("parse_error").alias("reason"),
        F.col("bad_value").alias("value"))


def message_id(session_col="session_id", line_col="line_num"):
    """P5: the entry's uuid, else ``{session_id}-{line_num}`` (null uuid = missing, D1)."""
    return F.coalesce(F.col("uuid"), F.concat_ws("-", F.col(session_col), F.col(line_col).cast("string")))
