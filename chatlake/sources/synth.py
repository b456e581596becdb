"""Transcript corpora rendered from the driver's tables (test and bench input).

The driver ships Parquet tables, not transcript files. To run the real
parse path on them, rows are rendered as JSON transcript lines by Spark
(``to_json`` and string concatenation, no Python per row), then fed to
:func:`chatlake.operators.parse.parse_lines` like lines read from disk.
Each rule below is simple enough that an oracle can compute the same
answers straight from the tables with SQL.

``conversations(conv_id, turn, role, text)`` — one line per row, ``n`` =
length(text):

* session ``[agent-]conv-<conv_id>`` (agent when conv_id % 10 = 0); source
  cowork when conv_id % 4 = 3; project ``/p/<conv_id % 7>`` (dir ``-p-…``);
  line number = turn; time = 1704067200 + conv_id*1800 + turn*45 seconds,
  written as ISO text on even turns and epoch millis on odd turns.
* system rows: a ``turn_duration`` entry of n*10 ms (millis timestamp).
* user rows, turn < 2: string content, prefixed by a command tag pair
  ``grp:cmd<conv_id % 4>`` / args ``<turn>`` when conv_id % 5 = 0.
* user rows, turn >= 2: a tool result for the previous turn's tool call
  (error when n % 5 = 0) then a text block.
* assistant rows: thinking (first 20 chars, when turn % 4 = 3), text, and
  one tool call named by (conv_id + turn) % 6 with a file path and a shell
  command; model ``model-<(conv_id+turn) % 4>`` and usage unless
  conv_id % 9 = 4.

``events(event_id, ts, user_id, event_type, value, props)`` — one
assistant line per event in session ``u<user_id>-<day>``, ordered by
(ts, event_id); tool name = event_type; usage input = floor(value*100).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordinal import dense_position
from ..session import joins_by_seen_size, shuffles_freed, spread
from . import files

#: Turns of conversations that a task renders and parses.
TURNS_EACH = 20_000
#: Bytes of a file system's block, which the smallest file takes, and of an event's line.
BLOCK_BYTES, EVENT_BYTES = 4096, 400
#: Bytes of disk that the transcripts of a part of the corpus take, about.
PART_BYTES = 32 << 30

# Fixed values of the corpus definition.
BASE_EPOCH = 1704067200
TOOL_NAMES = ["Read", "Write", "Edit", "Grep", "Bash", "WebFetch"]
# Price table used with the corpus: three tiers, model-3 left out so that
# it takes the fallback rates.
CORPUS_PRICES = {
    "model-0": (15.00, 75.00, 1.50, 18.75),
    "model-1": (3.00, 15.00, 0.30, 3.75),
    "model-2": (0.80, 4.00, 0.08, 1.00),
}

_BLOCK = ("type string, text string, thinking string, id string, name string, "
          "input struct<file_path string, command string>, tool_use_id string, "
          "is_error boolean, content string")
_BLOCK_FIELDS = ["type", "text", "thinking", "id", "name", "input", "tool_use_id",
                 "is_error", "content"]


def _q(c: Column) -> Column:
    """JSON string literal of a column (quoted and escaped)."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def _kv(key: str, value_json: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), value_json)


def _obj(*pairs: Column) -> Column:
    """JSON object from "key":value pieces; NULL pieces are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _block(**fields) -> Column:
    out = []
    for n in _BLOCK_FIELDS:
        v = fields.get(n)
        out.append((v if v is not None else F.lit(None)).alias(n))
    return F.struct(*out).cast(f"struct<{_BLOCK}>")


def _load_rank(source: Column) -> Column:
    return F.when(source == "cowork", F.lit(1)).otherwise(F.lit(0))


def conversation_lines(conversations: DataFrame) -> DataFrame:
    cid, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    n = F.length("text")
    c = conversations.select(
        cid, turn, role, "text", n.alias("n"),
        F.concat(F.when(cid % 10 == 0, F.lit("agent-")).otherwise(F.lit("")),
                 F.lit("conv-"), cid.cast("string")).alias("session_id"),
        (F.lit(BASE_EPOCH) + cid * 1800 + turn * 45).cast("long").alias("ts_sec"),
    )
    n, sid = F.col("n"), F.col("session_id")
    millis = (F.col("ts_sec") * 1000).cast("string")
    iso = _q(F.date_format(F.timestamp_seconds("ts_sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ts_json = F.when(turn % 2 == 0, iso).otherwise(millis)
    uuid = F.concat(sid, F.lit("-m"), turn.cast("string"))
    project = F.concat(F.lit("/p/"), (cid % 7).cast("string"))
    model = F.when(cid % 9 != 4, F.concat(F.lit("model-"), ((cid + turn) % 4).cast("string")))
    tool_name = F.element_at(F.array(*[F.lit(t) for t in TOOL_NAMES]), ((cid + turn) % 6 + 1).cast("int"))
    cmd_prefix = F.when(cid % 5 == 0, F.concat(
        F.lit("<command-message>grp:cmd"), (cid % 4).cast("string"),
        F.lit("</command-message><command-args>"), turn.cast("string"), F.lit("</command-args>")))
    user_string = _q(F.concat(F.coalesce(cmd_prefix, F.lit("")), F.col("text")))
    user_blocks = F.to_json(F.array(
        _block(type=F.lit("tool_result"),
               tool_use_id=F.concat(sid, F.lit("-m"), (turn - 1).cast("string"), F.lit("-t")),
               is_error=(n % 5 == 0), content=F.lit("ok")),
        _block(type=F.lit("text"), text=F.col("text"))))
    tool_use = _block(
        type=F.lit("tool_use"), id=F.concat(uuid, F.lit("-t")), name=tool_name,
        input=F.struct(
            F.concat(F.lit("/src/f"), (n % 17).cast("string"), F.lit(".py")).alias("file_path"),
            F.concat(F.lit("cat /etc/c"), (n % 5).cast("string"), F.lit(".cfg | wc /tmp/x")).alias("command")))
    asst_blocks = F.to_json(F.array_compact(F.array(
        F.when(turn % 4 == 3, _block(type=F.lit("thinking"), thinking=F.col("text"))),
        _block(type=F.lit("text"), text=F.col("text")),
        tool_use)))
    usage = F.when(model.isNotNull(), F.to_json(F.struct(
        n.alias("input_tokens"), (n % 101).alias("output_tokens"),
        (n % 7 * 10).alias("cache_creation_input_tokens"), (n % 13 * 20).alias("cache_read_input_tokens"),
        F.lit("standard").alias("service_tier"))))
    is_user = role == "user"
    message = F.when(is_user, _obj(
        _kv("role", F.lit('"user"')),
        _kv("content", F.when(turn < 2, user_string).otherwise(user_blocks)),
    )).otherwise(_obj(
        _kv("role", F.lit('"assistant"')),
        _kv("model", _q(model)),
        _kv("id", _q(F.concat(F.lit("msg-"), cid.cast("string"), F.lit("-"), turn.cast("string")))),
        _kv("stop_reason", F.lit('"tool_use"')),
        _kv("content", asst_blocks),
        _kv("usage", usage),
    ))
    msg_line = _obj(
        _kv("type", _q(role)),
        _kv("timestamp", ts_json),
        _kv("uuid", _q(uuid)),
        F.when(turn > 0, _kv("parentUuid", _q(F.concat(sid, F.lit("-m"), (turn - 1).cast("string"))))),
        _kv("isSidechain", F.when(turn % 5 == 4, F.lit("true")).otherwise(F.lit("false"))),
        F.when(turn > 0, _kv("gitBranch", _q(F.concat(F.lit("b"), (cid % 3).cast("string"))))),
        F.when(turn > 0, _kv("cwd", _q(project))),
        _kv("version", _q(F.concat(F.lit("2.0."), (cid % 3).cast("string")))),
        F.when(cid % 10 == 0, _kv("agentId", _q(F.concat(F.lit("ag"), cid.cast("string"))))),
        _kv("message", message),
    )
    sys_line = _obj(
        F.lit('"type":"system"'), F.lit('"subtype":"turn_duration"'),
        _kv("durationMs", (n * 10).cast("string")), _kv("timestamp", millis))
    source = F.when(cid % 4 == 3, F.lit("cowork")).otherwise(F.lit("claude-code"))
    return c.select(
        source.alias("source"),
        F.concat(F.lit("synthetic://conversations/"), sid, F.lit(".jsonl")).alias("file_path"),
        sid.alias("session_id"), (cid % 10 == 0).alias("is_agent"),
        F.concat(F.lit("-p-"), (cid % 7).cast("string")).alias("project_dir_name"),
        project.alias("project_path"),
        F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"),
        _load_rank(source).alias("load_rank"),
        turn.cast("long").alias("line_num"),
        F.when(role == "system", sys_line).otherwise(msg_line).alias("value"),
    )


def event_lines(events: DataFrame) -> DataFrame:
    uid = F.col("user_id")
    ev = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.concat(F.lit("u"), uid.cast("string"), F.lit("-"),
                 F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("session_id"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    # Line numbers: position by (ts, event_id) in the session, cut in one-second
    # blocks so a hot user never lands in a single task.
    ev = dense_position(ev, ["session_id"], ["ts", "event_id"],
                        F.floor(F.unix_micros("ts") / F.lit(1000000)).cast("long"), out="line_num")
    eid = F.col("event_id").cast("string")
    project = F.concat(F.lit("/u/"), (uid % 5).cast("string"))
    tool_use = F.to_json(F.array(_block(
        type=F.lit("tool_use"), id=F.concat(F.lit("e"), eid, F.lit("-t")), name=F.col("event_type"),
        input=F.struct(F.concat(F.lit("/src/f"), F.col("k"), F.lit(".py")).alias("file_path"),
                       F.lit(None).cast("string").alias("command")))))
    usage = F.to_json(F.struct(
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.lit(0).alias("output_tokens"), F.lit(0).alias("cache_creation_input_tokens"),
        F.lit(0).alias("cache_read_input_tokens")))
    message = _obj(
        _kv("role", F.lit('"assistant"')),
        _kv("model", _q(F.concat(F.lit("model-"), (F.col("event_id") % 4).cast("string")))),
        _kv("id", _q(F.concat(F.lit("msg-e"), eid))),
        _kv("content", tool_use), _kv("usage", usage))
    line = _obj(
        F.lit('"type":"assistant"'),
        _kv("timestamp", _q(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))),
        _kv("uuid", _q(F.concat(F.lit("e"), eid))),
        _kv("cwd", _q(project)),
        _kv("message", message))
    sid = F.col("session_id")
    return ev.select(
        F.lit("claude-code").alias("source"),
        F.concat(F.lit("synthetic://events/"), sid, F.lit(".jsonl")).alias("file_path"),
        sid, F.lit(False).alias("is_agent"),
        F.concat(F.lit("-u-"), (uid % 5).cast("string")).alias("project_dir_name"),
        project.alias("project_path"),
        F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"),
        F.lit(0).alias("load_rank"), F.col("line_num").cast("long"), line.alias("value"),
    )


def _day() -> Column:
    return F.to_date(F.col("ts").cast("timestamp"))


def _dealt(df: DataFrame, part: int, of: int, *keys: str | Column) -> DataFrame:
    """The rows of one of ``of`` parts. The keys name a session, so all its rows are in one part."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(of)) == part) if of > 1 else df


def corpus_lines(spark: SparkSession, sf_dir: str, which: str = "all", part: int = 0, of: int = 1) -> DataFrame:
    """Lines of the conversation corpus, the event corpus, or both; of one of ``of`` parts of their sessions."""
    parts = []
    if which in ("all", "conversations"):
        turns = _dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), part, of, "conv_id")
        parts.append(conversation_lines(spread(turns, TURNS_EACH)))
    if which in ("all", "events"):
        parts.append(event_lines(_dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), part, of, "user_id", _day())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schemas.LINES.fields])


def conversation_sidecars(conversations: DataFrame) -> DataFrame:
    """Cowork sidecar JSON for each cowork conversation (rendered from turn 0).

    sessionId ``local_<conv_id>``, title ``Task <conv_id>``, the turn-0 text as
    initial message, model ``model-<conv_id % 4>``, created at the
    conversation start (ISO), last activity one hour later (epoch millis),
    VM ``vm-<conv_id % 5>``, folder ``/p/<conv_id % 7>``, archived when
    conv_id is odd.
    """
    cid = F.col("conv_id")
    start = (F.lit(BASE_EPOCH) + cid * 1800).cast("long")
    c = conversations.filter((F.col("turn") == 0) & (cid % 4 == 3))
    sidecar = F.to_json(F.struct(
        F.concat(F.lit("local_"), cid.cast("string")).alias("sessionId"),
        F.concat(F.lit("Task "), cid.cast("string")).alias("title"),
        F.col("text").alias("initialMessage"),
        F.concat(F.lit("model-"), (cid % 4).cast("string")).alias("model"),
        F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        ((start + 3600) * 1000).alias("lastActivityAt"),
        F.concat(F.lit("vm-"), (cid % 5).cast("string")).alias("vmProcessName"),
        F.array(F.concat(F.lit("/p/"), (cid % 7).cast("string"))).alias("userSelectedFolders"),
        (cid % 2 == 1).alias("isArchived")))
    sid = F.concat(F.when(cid % 10 == 0, F.lit("agent-")).otherwise(F.lit("")),
                   F.lit("conv-"), cid.cast("string"))
    return c.select(
        F.concat(F.lit("local_"), cid.cast("string")).alias("cowork_dir_id"),
        sid.alias("session_id"), F.lit(1).alias("load_rank"),
        F.concat(F.lit("synthetic://conversations/"), sid, F.lit(".jsonl")).alias("file_path"),
        sidecar.alias("sidecar_text"))


def corpus_files(spark: SparkSession, sf_dir: str, which: str = "all") -> DataFrame:
    """One FILE_COLS row per corpus session, straight from the tables (no rendering)."""
    parts = []
    if which in ("all", "conversations"):
        cid = F.col("conv_id")
        sid = F.concat(F.when(cid % 10 == 0, F.lit("agent-")).otherwise(F.lit("")),
                       F.lit("conv-"), cid.cast("string"))
        source = F.when(cid % 4 == 3, F.lit("cowork")).otherwise(F.lit("claude-code"))
        conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
        parts.append(conv.select(
            source.alias("source"), F.concat(F.lit("synthetic://conversations/"), sid, F.lit(".jsonl")).alias("file_path"),
            sid.alias("session_id"), (cid % 10 == 0).alias("is_agent"),
            F.concat(F.lit("-p-"), (cid % 7).cast("string")).alias("project_dir_name"),
            F.concat(F.lit("/p/"), (cid % 7).cast("string")).alias("project_path"),
            F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"),
            _load_rank(source).alias("load_rank")))
    if which in ("all", "events"):
        uid = F.col("user_id")
        ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
            "user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).distinct()
        sid = F.concat(F.lit("u"), uid.cast("string"), F.lit("-"), F.col("day"))
        parts.append(ev.select(
            F.lit("claude-code").alias("source"), F.concat(F.lit("synthetic://events/"), sid, F.lit(".jsonl")).alias("file_path"),
            sid.alias("session_id"), F.lit(False).alias("is_agent"),
            F.concat(F.lit("-u-"), (uid % 5).cast("string")).alias("project_dir_name"),
            F.concat(F.lit("/u/"), (uid % 5).cast("string")).alias("project_path"),
            F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"),
            F.lit(0).alias("load_rank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_parts(spark: SparkSession, sf_dir: str, part_bytes: int = PART_BYTES) -> int:
    """Parts of the corpus whose files take about ``part_bytes`` of disk each, by an estimate.

    A file takes a block at least, a cowork conversation (one of four) also a sidecar and four folders."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").agg(
        F.approx_count_distinct("conv_id"), F.sum(F.octet_length("text"))).first()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").agg(
        F.approx_count_distinct(F.struct("user_id", _day())), F.count(F.lit(1))).first()
    blocks = events[0] + turns[0] * 9 // 4
    return max(1, -(-(blocks * BLOCK_BYTES + events[1] * EVENT_BYTES + (turns[1] or 0)) // part_bytes))


def write_corpus_files(spark: SparkSession, sf_dir: str, root: str, part: int = 0, of: int = 1) -> int:
    """The corpus, or one of ``of`` parts of it, as transcript trees under ``root``; returns the number of files.

    ``claude/projects/<project dir>/<session>.jsonl``, and for each cowork
    conversation ``cowork/local_<conv_id>.json`` (its sidecar) beside
    ``cowork/local_<conv_id>/.claude/projects/<project dir>/<session>.jsonl``.
    """
    lines = corpus_lines(spark, sf_dir, part=part, of=of)
    name = F.concat("project_dir_name", F.lit("/"), "session_id", F.lit(".jsonl"))
    local = F.concat(F.lit("local_"), F.regexp_extract("session_id", r"(\d+)$", 1))
    path = (F.when(F.col("source") == "cowork", F.concat(F.lit("cowork/"), local, F.lit("/.claude/projects/"), name))
            .otherwise(F.concat(F.lit("claude/projects/"), name)))
    conversations = _dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), part, of, "conv_id")
    sidecars = conversation_sidecars(conversations).select(
        F.concat(F.lit("cowork/"), "cowork_dir_id", F.lit(".json")).alias("path"), F.lit(0).cast("long").alias("line_num"),
        F.col("sidecar_text").alias("value"))
    rows = (lines.select(path.alias("path"), "line_num", "value").unionByName(sidecars)
            .repartition("path").sortWithinPartitions("path", "line_num").select("path", "value"))
    with joins_by_seen_size(spark), shuffles_freed(spark):
        return files.write_lines(rows, root)
