"""A corpus that reaches the parse rules which ordinary transcripts seldom do.

Each row of ``documents`` (``d`` = doc_id, ``t`` = text, null: empty) is a
session ``rule-<d>`` of eight lines; ``long`` is ``t`` repeated beyond 50,000
characters when d % 50 = 0, else ``t``. Times are 2024-03-01 plus d minutes.

0. user without uuid: a ``<command-name>`` tag, then ``long``; time at +05:30.
1. user entry with role assistant and a null uuid: text, an unknown block and a
   text block without text; usage missing, ``{}``, partial or with a null by
   d % 4; an empty model when d is even; time without offset.
2. assistant entry with an empty role: ``long`` and an empty thought, a call
   whose input passes 2,000 characters and names its path as ``notebook_path``,
   a call without id and one without name; time with microseconds at -0800.
3. assistant entry without role: the id of line 2's call again, an id that
   session d or d + 1 has as well, a command past 1,000 characters; no date.
4. user: two results for one call, the last counts, one with an empty id, one
   for the shared call; snippets past 200 characters; no time.
5. user: command with arguments past 500 characters in Unicode white space; a date.
6. user with the uuid of line 5, which keeps its place. 7. user without uuid.

``RULES`` states the same tables in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .synth import _kv, _obj, _q

# Fixed values of the corpus definition.
START = 1709251200
LONG_TEXT = 50000
EDGE_SPACE = "\u2003\u00a0 "


def _text(c: Column) -> Column:
    return F.concat(F.lit('{"type":"text","text":'), _q(c), F.lit("}"))


def _call(call_id, name, tool_input) -> Column:
    return _obj(F.lit('"type":"tool_use"'), *([_kv("id", _q(call_id))] if call_id is not None else []),
                *([_kv("name", _q(F.lit(name)))] if name else []), _kv("input", tool_input))


def _result(call_id, error: Column, content: Column) -> Column:
    return _obj(F.lit('"type":"tool_result"'), _kv("tool_use_id", _q(call_id)),
                _kv("is_error", F.when(error, F.lit("true")).otherwise(F.lit("false"))), _kv("content", _q(content)))


def _list(*blocks: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *blocks), F.lit("]"))


def rule_lines(documents: DataFrame) -> DataFrame:
    d, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    ds = d.cast("string")
    times = F.when(d % 50 == 0, F.floor(F.lit(LONG_TEXT) / F.greatest(F.length(t), F.lit(1))) + 1).otherwise(F.lit(1)).cast("int")
    long = F.repeat(t, times)
    at = F.lit(START) + d * 60

    def time(shift: int, form: str, end: str = "") -> Column:
        return _q(F.concat(F.date_format(F.timestamp_seconds(at + shift), form), F.lit(end)))

    def line(kind: str, message: Column, when=None, uuid=None) -> Column:
        return _obj(_kv("type", F.lit(f'"{kind}"')), *([_kv("uuid", uuid)] if uuid is not None else []),
                    *([_kv("timestamp", when)] if when is not None else []), _kv("message", message))

    def uuid(n: int) -> Column:
        return _q(F.concat(F.lit("u"), ds, F.lit(f"-{n}")))

    def user(content: Column) -> Column:
        return _obj(F.lit('"role":"user"'), _kv("content", content))

    own, shared = F.concat(F.lit("c"), ds), F.concat(F.lit("s"), F.floor(d / 2).cast("string"))
    usage = (F.when(d % 4 == 1, F.lit("{}")).when(d % 4 == 2, F.lit('{"input_tokens":7}'))
             .when(d % 4 == 3, F.concat(F.lit('{"input_tokens":null,"output_tokens":'), (d % 100).cast("string"), F.lit("}"))))
    first = F.concat(F.lit('{"file_path":"","notebook_path":"/n/'), ds, F.lit('.ipynb","command":"'), F.repeat(F.lit("abcdefgh "), (d % 500).cast("int")), F.lit('"}'))
    shell = F.concat(F.lit('{"command":"cat /e/'), ds, F.lit(".cfg"), F.repeat(F.lit(" wxyz"), (d % 300).cast("int")), F.lit('"}'))
    lines = [
        line("user", user(_q(F.concat(F.lit("<command-name>/ do:x"), (d % 4).cast("string"), F.lit(" </command-name>"), long))),
             time(19800, "yyyy-MM-dd'T'HH:mm:ss", "+05:30")),
        line("user", _obj(F.lit('"role":"assistant"'), _kv("model", F.when(d % 2 == 0, F.lit('""')).otherwise(F.lit('"model-1"'))),
                          _kv("content", _list(_text(t), F.lit('{"type":"image"}'), F.lit('{"type":"text"}'))), _kv("usage", usage)),
             time(0, "yyyy-MM-dd HH:mm:ss"), F.lit("null")),
        line("assistant", _obj(F.lit('"role":""'), _kv("content", _list(
            F.concat(F.lit('{"type":"thinking","thinking":'), _q(long), F.lit("}")), F.lit('{"type":"thinking"}'),
            _call(own, "Read", first), _call(None, "Lost", F.lit("{}")), _call(F.concat(F.lit("n"), ds), None, F.lit("{}"))))),
             time(-28800, "yyyy-MM-dd'T'HH:mm:ss", ".123456-0800"), uuid(2)),
        line("assistant", _obj(F.lit('"model":"model-2"'), _kv("content", _list(
            _call(own, "Write", F.lit('{"file_path":"/w"}')), _call(shared, "Bash", shell),
            _call(F.concat(F.lit("g"), ds), "Grep", F.lit('{"path":"/g/x"}')))),
            F.lit('"usage":{"input_tokens":5,"output_tokens":4,"cache_creation_input_tokens":3,"cache_read_input_tokens":2}')),
             F.lit('"yesterday"'), uuid(3)),
        line("user", user(_list(_result(own, F.lit(True), F.concat(F.lit("r"), t)), _result(own, d % 3 == 0, F.lit("ok")),
                                _result(F.lit(""), F.lit(True), F.lit("ok")), _result(shared, d % 3 == 1, F.lit("ok")))), None, uuid(4)),
        line("user", user(_q(F.concat(F.lit("<command-message>go</command-message><command-args>" + EDGE_SPACE + "a"), F.replace(t, F.lit("<"), F.lit("")),
                                      F.lit("z" + EDGE_SPACE + "</command-args>")))), time(0, "yyyy-MM-dd"), uuid(5)),
        line("user", user(_q(F.lit("again"))), time(0, "yyyy-MM-dd"), uuid(5)),
        line("user", user(_q(F.lit("last"))), time(0, "yyyy-MM-dd")),
    ]
    sid = F.concat(F.lit("rule-"), ds)
    rows = documents.select("doc_id", F.posexplode(F.array(*lines)).alias("line_num", "value"))
    return rows.select(
        F.lit("claude-code").alias("source"), F.concat(F.lit("synthetic://rules/"), sid, F.lit(".jsonl")).alias("file_path"),
        sid.alias("session_id"), F.lit(False).alias("is_agent"), F.lit("-r").alias("project_dir_name"), F.lit("/r").alias("project_path"),
        F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"), F.lit(0).alias("load_rank"),
        F.col("line_num").cast("long"), "value").select(*[F.col(f.name).cast(f.dataType) for f in schemas.LINES.fields])


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '... [truncated]' ELSE {c} END"


RULES = f"""
WITH r0 AS (
  SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS ds, COALESCE(text, '') AS t, 'rule-' || CAST(doc_id AS VARCHAR) AS session_id,
    repeat(COALESCE(text, ''), CASE WHEN doc_id % 50 = 0 THEN {LONG_TEXT} // greatest(length(COALESCE(text, '')), 1) + 1 ELSE 1 END) AS long,
    make_timestamp(CAST(({START} + doc_id * 60) * 1000000 AS BIGINT)) AS at0
  FROM documents
),
r1 AS (
  SELECT *, '<command-name>/ do:x' || CAST(d % 4 AS VARCHAR) || ' </command-name>' || long AS said0,
    long || chr(10) || '---' || chr(10) AS thought, 's' || CAST(d // 2 AS VARCHAR) AS shared, date_trunc('day', at0) AS day0,
    'a' || replace(t, '<', '') || 'z' AS args5,
    '{{"file_path":"","notebook_path":"/n/' || ds || '.ipynb","command":"' || repeat('abcdefgh ', d % 500) || '"}}' AS input2,
    repeat('abcdefgh ', d % 500) AS command2,
    '{{"command":"cat /e/' || ds || '.cfg' || repeat(' wxyz', d % 300) || '"}}' AS input3, 'cat /e/' || ds || '.cfg' || repeat(' wxyz', d % 300) AS command3
  FROM r0
),
r_messages AS (
  SELECT session_id, 'rule-' || ds || '-0' AS message_id, 'user' AS role, at0 AS "timestamp", 0 AS sequence_number, {_cut('said0', 50000)} AS content_text,
    false AS has_thinking, CAST(NULL AS VARCHAR) AS thinking_text, CAST(NULL AS VARCHAR) AS model,
    CAST(NULL AS INTEGER) AS input_tokens, CAST(NULL AS INTEGER) AS output_tokens, CAST(NULL AS INTEGER) AS cache_creation_input_tokens, CAST(NULL AS INTEGER) AS cache_read_input_tokens
  FROM r1
  UNION ALL SELECT session_id, 'rule-' || ds || '-1', 'assistant', at0, 1, {_cut("(t || chr(10))", 50000)}, false, NULL,
    CASE WHEN d % 2 = 0 THEN '' ELSE 'model-1' END, CASE d % 4 WHEN 2 THEN 7 WHEN 3 THEN 0 END,
    CASE d % 4 WHEN 2 THEN 0 WHEN 3 THEN d % 100 END, CASE WHEN d % 4 >= 2 THEN 0 END, CASE WHEN d % 4 >= 2 THEN 0 END FROM r1
  UNION ALL SELECT session_id, 'u' || ds || '-2', 'assistant', at0 + INTERVAL 123456 MICROSECONDS, 2, '', true, {_cut('thought', 50000)}, NULL, NULL, NULL, NULL, NULL FROM r1
  UNION ALL SELECT session_id, 'u' || ds || '-3', 'assistant', NULL, 3, '', false, NULL, 'model-2', 5, 4, 3, 2 FROM r1
  UNION ALL SELECT session_id, 'u' || ds || '-4', 'user', NULL, 4,
    '[tool_result: ' || substr('r' || t, 1, 200) || ']' || repeat(chr(10) || '[tool_result: ok]', 3), false, NULL, NULL, NULL, NULL, NULL, NULL FROM r1
  UNION ALL SELECT session_id, 'u' || ds || '-5', 'user', day0, 5,
    {_cut("('<command-message>go</command-message><command-args>" + EDGE_SPACE + "' || args5 || '" + EDGE_SPACE + "</command-args>')", 50000)},
    false, NULL, NULL, NULL, NULL, NULL, NULL FROM r1
  UNION ALL SELECT session_id, 'rule-' || ds || '-7', 'user', day0, 6, 'last', false, NULL, NULL, NULL, NULL, NULL, NULL FROM r1
),
r_calls0 AS (
  SELECT 'c' || ds AS tool_call_id, 'u' || ds || '-2' AS message_id, session_id, 'Read' AS tool_name, {_cut('input2', 2000)} AS input_summary,
    at0 + INTERVAL 123456 MICROSECONDS AS "timestamp", '/n/' || ds || '.ipynb' AS file_path, {_cut('command2', 1000)} AS command, (d % 3 = 0) AS has_error FROM r1
  UNION ALL SELECT shared, 'u' || ds || '-3', session_id, 'Bash', {_cut('input3', 2000)}, NULL, NULL, {_cut('command3', 1000)}, d % 3 = 1 FROM r1
  UNION ALL SELECT 'g' || ds, 'u' || ds || '-3', session_id, 'Grep', '{{"path":"/g/x"}}', NULL, '/g/x', NULL, false FROM r1
),
r_tool_calls AS (
  SELECT * FROM r_calls0 QUALIFY row_number() OVER (PARTITION BY tool_call_id ORDER BY 'synthetic://rules/' || session_id || '.jsonl') = 1
),
r_commands AS (
  SELECT session_id, 'rule-' || ds || '-0' AS message_id, at0 AS "timestamp", 'do:x' || CAST(d % 4 AS VARCHAR) AS command_name,
    CAST(NULL AS VARCHAR) AS command_args, true AS is_skill FROM r1
  UNION ALL SELECT session_id, 'u' || ds || '-5', day0, 'go', {_cut('args5', 500)}, false FROM r1
),
r_model_usage AS (
  SELECT session_id, CASE WHEN model = '' OR model IS NULL THEN 'unknown' ELSE model END AS model, CAST(count(*) AS INTEGER) AS message_count,
    CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(cache_creation_input_tokens) AS BIGINT) AS total_cache_creation_tokens, CAST(sum(cache_read_input_tokens) AS BIGINT) AS total_cache_read_tokens
  FROM r_messages WHERE role = 'assistant' AND input_tokens IS NOT NULL GROUP BY 1, 2
)
"""


def rules_oracle(body: str) -> str:
    """A full statement over the r_* tables."""
    return RULES + body
