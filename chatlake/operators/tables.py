"""Entries -> the six per-session output tables.

Shuffle plan: the sessions rollup is one aggregate on ``session_id``
(partial aggregation first, so a huge session is pre-combined map-side; it
runs sort-based because first-value string buffers are not fixed-width).
Messages get their sequence numbers from the skew-safe block positions in
:mod:`chatlake.operators.ordinal`. Tool results are reduced per
``(session_id, tool_use_id)`` before the join, a key with no hot values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import pricing
from ..functions.text import (MAX_COMMAND, MAX_COMMAND_ARGS, MAX_CONTENT_TEXT,
                              MAX_INPUT_SUMMARY, bash_paths, nonempty, truncate)
from .ordinal import line_position
from .parse import message_id

# Tool names (lower-cased) kept as their own file operation;
# any other tool with a path counts as "other", Bash-mined paths as "bash".
FILE_OPS = ["read", "write", "edit", "glob", "grep", "notebookedit"]


# Place of a stored tool call in load order; not a column of any view.
LOAD_ORDER = "load_order"


def build_messages(entries: DataFrame) -> DataFrame:
    """P3 + W1: one row per user/assistant entry; sequence numbers are 0-based.

    Of lines of one session with the same message id the first counts. Which
    lines count, and their places, are found on rows of ids and line numbers;
    the rows with texts are shuffled once, to join these on (session, line)."""
    said = entries.filter(F.col("is_message"))
    first = said.groupBy("session_id", message_id().alias("message_id")).agg(F.min("line_num").alias("line_num"))
    places = line_position(first, ["session_id"], "line_num", out="sequence_number")
    msgs = said.select(
        "session_id", "parent_uuid", "role",
        F.col("ts").alias("timestamp"), "line_num",
        truncate("text", MAX_CONTENT_TEXT).alias("content_text"),
        "has_thinking", truncate("thinking_text", MAX_CONTENT_TEXT).alias("thinking_text"),
        "stop_reason", "model", "api_message_id",
        F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"), "cwd", "git_branch",
        *[F.col(c).try_cast("int").alias(c) for c in
          ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")],
        "service_tier", "inference_geo",
    )
    return msgs.join(places, ["session_id", "line_num"]).select(*[F.col(f.name).cast(f.dataType) for f in schemas.MESSAGES.fields])


def _tool_use_rows(entries: DataFrame) -> DataFrame:
    """every tool_use block of assistant messages, before any dedupe."""
    tu = entries.filter(F.col("tool_uses").isNotNull() & (F.size("tool_uses") > 0)).select(
        "session_id", "load_rank", "file_path", "line_num", "ts",
        message_id().alias("message_id"),
        F.posexplode("tool_uses").alias("pos", "tu"))
    return tu.select(
        "session_id", "load_rank", "file_path", "line_num", "pos", "ts", "message_id",
        F.col("tu")["id"].alias("tool_call_id"), F.col("tu")["name"].alias("tool_name"),
        F.coalesce(F.col("tu")["input"], F.lit("{}")).alias("input_raw"),
        F.col("tu")["path"].alias("path"), F.col("tu")["command"].alias("command_raw"),
        F.col("tu")["description"].alias("description"),
    )


def build_tool_calls(entries: DataFrame) -> DataFrame:
    """J1 + P7 + W3: tool calls with their error flag, first write wins per id."""
    return first_call_wins(session_tool_calls(entries))


def first_call_wins(rows: DataFrame) -> DataFrame:
    """W3 over all sessions: the first call in load order keeps its id."""
    return first_wins(rows, ["tool_call_id"], LOAD_ORDER, schemas.TOOL_CALLS)


def session_tool_calls(entries: DataFrame) -> DataFrame:
    """J1 + P7: one row for each call id of a session, with its place in load
    order. This is what a batch stores: which session keeps an id that several
    have does not depend on how files were dealt to batches. Inputs are cut
    before any shuffle."""
    calls = _tool_use_rows(entries).filter(F.col("tool_call_id").isNotNull() & F.col("tool_name").isNotNull()).withColumns({
        "input_summary": truncate("input_raw", MAX_INPUT_SUMMARY), "command": truncate("command_raw", MAX_COMMAND),
        LOAD_ORDER: F.struct("load_rank", "file_path", "line_num", "pos")}).drop("input_raw", "command_raw", "file_path")
    calls = calls.withColumnsRenamed({"ts": "timestamp", "path": "file_path"})
    values = ["message_id", "tool_name", "input_summary", "timestamp", "file_path", "command", "description"]
    calls = calls.groupBy("session_id", "tool_call_id").agg(F.min_by(F.struct(*values, LOAD_ORDER), F.col(LOAD_ORDER)).alias("_v"))
    results = (entries.filter(F.col("tool_results").isNotNull() & (F.size("tool_results") > 0))
               .select("session_id", "line_num", F.posexplode("tool_results").alias("pos", "r"))
               .groupBy("session_id", F.col("r")["tool_use_id"].alias("tool_call_id"))
               # Last result wins.
               .agg(F.max_by(F.col("r")["is_error"], F.struct("line_num", "pos")).alias("res_error")))
    rows = calls.join(results, ["session_id", "tool_call_id"], "left").select(
        "session_id", "tool_call_id", "_v.*", F.lit(None).cast("string").alias("result_message_id"),
        F.coalesce("res_error", F.lit(False)).alias("has_error"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TOOL_CALLS.fields], LOAD_ORDER)


def build_commands(entries: DataFrame) -> DataFrame:
    """F8 rows; UNIQUE(session_id, message_id, command_name), first wins."""
    rows = entries.filter(F.col("command").isNotNull()).select(
        "session_id", message_id().alias("message_id"), F.col("ts").alias("timestamp"),
        F.col("command")["command_name"].alias("command_name"),
        truncate(F.col("command")["command_args"], MAX_COMMAND_ARGS).alias("command_args"),
        F.col("command")["is_skill"].alias("is_skill"),
        F.col("line_num").alias("_ord"))
    return first_wins(rows, ["session_id", "message_id", "command_name"], "_ord",
                      schemas.COMMAND_INVOCATIONS)


def build_files_referenced(entries: DataFrame, session_starts: DataFrame) -> DataFrame:
    """A12 + A13 + U2 + J5: (session, path, op) counts, stamped with the session start.

    Each tool use yields its path row and its Bash-mined path rows in one
    array, so the entries are scanned and exploded once.
    """
    calls = _tool_use_rows(entries)
    name_lc = F.lower("tool_name")
    pair_type = "array<struct<file_path:string,operation:string>>"
    by_tool = F.when(nonempty("path").isNotNull(), F.array(F.struct(
        F.col("path").alias("file_path"),
        F.when(name_lc.isin(*FILE_OPS), name_lc).otherwise(F.lit("other")).alias("operation")))
    ).otherwise(F.array().cast(pair_type))
    by_bash = F.when((F.col("tool_name") == "Bash") & nonempty("command_raw").isNotNull(),
                     F.transform(bash_paths("command_raw"),
                                 lambda p: F.struct(p.alias("file_path"), F.lit("bash").alias("operation")))
                     ).otherwise(F.array().cast(pair_type))
    counts = (calls.select("session_id", F.explode(F.concat(by_tool.cast(pair_type), by_bash.cast(pair_type))).alias("f"))
              .groupBy("session_id", F.col("f")["file_path"].alias("file_path"),
                       F.col("f")["operation"].alias("operation"))
              .agg(F.count(F.lit(1)).cast("int").alias("reference_count")))
    starts = session_starts.select("session_id", F.col("started_at").alias("first_referenced_at"))
    return counts.join(starts, "session_id", "left").select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.FILES_REFERENCED.fields])


def build_model_usage(entries: DataFrame) -> DataFrame:
    """Per (session, model or 'unknown'), assistant entries with usage."""
    return (entries.filter((F.col("role") == "assistant") & F.col("usage_present"))
            .groupBy("session_id", F.coalesce(nonempty("model"), F.lit("unknown")).alias("model"))
            .agg(F.count(F.lit(1)).cast("int").alias("message_count"),
                 F.sum("input_tokens").cast("long").alias("total_input_tokens"),
                 F.sum("output_tokens").cast("long").alias("total_output_tokens"),
                 F.sum("cache_creation_input_tokens").cast("long").alias("total_cache_creation_tokens"),
                 F.sum("cache_read_input_tokens").cast("long").alias("total_cache_read_tokens")))


def _first_in_line_order(c):
    """First non-empty value in line order (no sort: a min_by aggregate)."""
    return F.min_by(F.col(c), F.when(nonempty(c).isNotNull(), F.col("line_num")))


def session_rollup(entries: DataFrame) -> DataFrame:
    """A1-A8, A10 in one hash aggregate per session (partial + final)."""
    asst_usage = (F.col("role") == "assistant") & F.col("usage_present")

    def tsum(c):
        return F.coalesce(F.sum(F.when(asst_usage, F.col(c))), F.lit(0)).cast("long")

    model_order = F.when(F.col("is_message") & nonempty("model").isNotNull(), F.col("line_num"))
    return entries.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        _first_in_line_order("git_branch").alias("git_branch"),
        _first_in_line_order("cwd").alias("cwd"),
        _first_in_line_order("version").alias("claude_version"),
        F.min_by("model", model_order).alias("model"),
        _first_in_line_order("slug").alias("slug"),
        _first_in_line_order("agent_id").alias("agent_id"),
        F.count_if(F.col("role") == "user").cast("int").alias("user_message_count"),
        F.count_if(F.col("role") == "assistant").cast("int").alias("assistant_message_count"),
        F.coalesce(F.sum(F.coalesce(F.array_size("tool_uses"), F.lit(0))), F.lit(0)).cast("int").alias("tool_call_count"),
        F.count_if(F.col("command").isNotNull()).cast("int").alias("command_count"),
        tsum("input_tokens").alias("total_input_tokens"),
        tsum("output_tokens").alias("total_output_tokens"),
        tsum("cache_creation_input_tokens").alias("total_cache_creation_tokens"),
        tsum("cache_read_input_tokens").alias("total_cache_read_tokens"),
        F.coalesce(F.sum("turn_duration_ms"), F.lit(0.0)).alias("_turn_sum"),
        F.count("turn_duration_ms").cast("int").alias("turn_count"),
    )


def build_sessions(entries: DataFrame, prices: DataFrame, files: DataFrame | None = None,
                   extracted_at=None) -> DataFrame:
    """Sessions: file attributes ⟕ rollup, then price join (J2) and costs.

    ``files`` (one row per file, ``FILE_COLS``) keeps sessions whose file has
    no parsable line; without it file attributes come from the entries.
    """
    roll = session_rollup(entries)
    if files is None:
        files = entries.groupBy("session_id").agg(
            *[F.any_value(c).alias(c) for c in schemas.FILE_COLS if c != "session_id"])
    s = files.join(roll, "session_id", "left")
    tin, tout, tcc, tcr = ("total_input_tokens", "total_output_tokens",
                           "total_cache_creation_tokens", "total_cache_read_tokens")
    s = s.select(
        *[c for c in s.columns if c not in (tin, tout, tcc, tcr, "user_message_count",
                                            "assistant_message_count", "tool_call_count",
                                            "command_count", "turn_count")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (
            tin, tout, tcc, tcr, "user_message_count", "assistant_message_count",
            "tool_call_count", "command_count", "turn_count")])
    s = pricing.attach_prices(s, prices)
    all_in = F.col(tcr) + F.col(tcc) + F.col(tin)
    micros = F.unix_micros("ended_at") - F.unix_micros("started_at")
    costs = pricing.cost_columns(tin, tout, tcc, tcr)
    ext = F.current_timestamp() if extracted_at is None else F.lit(extracted_at).cast("timestamp")
    out = s.select(
        "*",
        F.coalesce(F.floor(micros / F.lit(1000000)), F.lit(0)).try_cast("int").alias("duration_seconds"),
        F.when(all_in > 0, F.col(tcr).cast("double") / all_in.cast("double")).alias("cache_hit_rate"),
        *[v.alias(k) for k, v in costs.items()],
        F.coalesce("_turn_sum", F.lit(0.0)).try_cast("long").alias("total_turn_duration_ms"),
        F.when(F.col("turn_count") > 0, F.col("_turn_sum") / F.col("turn_count")).alias("avg_turn_duration_ms"),
        F.col("file_size").alias("file_size_bytes"),
        ext.alias("extracted_at"),
        F.col("file_mtime").alias("jsonl_modified_at"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schemas.SESSIONS.fields])


def first_wins(rows: DataFrame, keys: list[str], order_col: str, schema) -> DataFrame:
    """Keep the first row per key by ``order_col`` (map-side combined)."""
    value_cols = [f.name for f in schema.fields if f.name not in keys]
    agg = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*value_cols), F.col(order_col)).alias("_v"))
    return agg.select(*keys, "_v.*").select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def last_wins(rows: DataFrame, keys: list[str], order_col: str, schema) -> DataFrame:
    """Keep the last row per key by ``order_col``."""
    value_cols = [f.name for f in schema.fields if f.name not in keys]
    agg = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*value_cols), F.col(order_col)).alias("_v"))
    return agg.select(*keys, "_v.*").select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


class LazyTables(Mapping):
    """Table name -> DataFrame, each plan built on first access only.

    Building a DataFrame runs Catalyst analysis; reports touch one or two
    tables, so the others are never planned.
    """

    def __init__(self, builders: dict):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._builders[name] = lambda: df
        self._built[name] = df

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def build_tables(entries: DataFrame, prices: DataFrame, files: DataFrame | None = None,
                 extracted_at=None) -> LazyTables:
    """The six per-session tables of ``entries`` (lazy mapping)."""
    def starts():
        return entries.groupBy("session_id").agg(F.min("ts").alias("started_at"))
    return LazyTables({
        "sessions": lambda: build_sessions(entries, prices, files, extracted_at),
        "messages": lambda: build_messages(entries),
        "tool_calls": lambda: build_tool_calls(entries),
        "command_invocations": lambda: build_commands(entries),
        "files_referenced": lambda: build_files_referenced(entries, starts()),
        "model_usage": lambda: build_model_usage(entries),
    })
