"""

Every query reads the driver's Parquet tables under ``sf_dir``, renders
them as transcript lines (see ``chatlake/sources/synth.py``), runs the real
parse path and table build on Spark, then the operator or report. The
oracle SQL states the same answer directly over the Parquet tables in
DuckDB (``chatlake/sources/synth_oracle.py``), so a match checks the whole
chain: JSON rendering, parsing, rollups, joins, windows and reports.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatlake.operators.ordinal import dense_position  # noqa: E402
from chatlake.operators.parse import quarantine  # noqa: E402
from chatlake.plans import reports as R  # noqa: E402
from chatlake.plans.corpus import CorpusTrees, corpus_tables  # noqa: E402
from chatlake.plans.incremental import changed_files  # noqa: E402
from chatlake.plans.partials import StoredReports, refresh  # noqa: E402
from chatlake.plans.sqlsurface import run_sql  # noqa: E402
from chatlake.plans.tiers import compact_tiers  # noqa: E402
from chatlake.plans import pipeline  # noqa: E402
from chatlake.session import apply_engine_conf, scratch_path  # noqa: E402
from chatlake.sources.synth import CORPUS_PRICES, corpus_files, corpus_lines  # noqa: E402
from chatlake.sources.export import export_csv, read_csv  # noqa: E402
from chatlake.sources.team import export_team, read_team_exports, team_daily, team_map  # noqa: E402
from chatlake.sources.synth_oracle import oracle  # noqa: E402
from chatlake.sources.synth_rules import rules_oracle  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF_TODAY = "2024-01-15"      # R12 "today"
AS_OF_DAILY = "2024-01-30"      # R16 reference day
DAILY_DAYS = 7                  # R16 window
MANIFEST_EPOCH = 1700000000     # J3 fixture mtimes


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    apply_engine_conf(spark)
    return corpus_tables(spark, sf_dir)


def _report(fn, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_tables(spark, sf_dir), **kw)


def _table(name: str, drop=()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _tables(spark, sf_dir)[name].drop(*drop)


_RULE_MESSAGES = ["session_id", "message_id", "role", "timestamp", "sequence_number", "content_text", "has_thinking", "thinking_text", "model",
                  "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
_RULE_CALLS = ["tool_call_id", "message_id", "session_id", "tool_name", "input_summary", "timestamp", "file_path", "command", "has_error"]


def _rules(name: str, columns=None) -> Callable[[SparkSession, str], DataFrame]:
    """A table of the corpus that reaches the rare rules (sources/synth_rules.py)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_engine_conf(spark)
        t = corpus_tables(spark, sf_dir, "rules")[name]
        return t.select(*columns) if columns else t
    return run


def _csv(report: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table exported as CSV and read back as text."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "csv")
        export_csv(report(spark, sf_dir), path, compression="gzip")
        return read_csv(spark, path)
    return run


def _ordered(fn, **kw) -> Callable[[SparkSession, str], DataFrame]:
    """A top-k report with each row's place. Its limit leaves one partition, whose row ids are the places."""
    return lambda spark, sf_dir: fn(_tables(spark, sf_dir), **kw).withColumn("place", F.monotonically_increasing_id())


def _manifest_pairs(spark: SparkSession, sf_dir: str):
    """FIXTURES 4.3: discovered files and a manifest from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    path = F.concat(F.lit("/data/doc-"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    base = F.lit(MANIFEST_EPOCH) + F.col("doc_id")
    discovered = docs.select(path.alias("file_path"), F.col("n_chars").alias("file_size"),
                             F.timestamp_seconds(base).alias("file_mtime"))
    state = docs.filter(F.col("doc_id") % 10 != 0).select(
        path.alias("file_path"),
        (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("file_size_bytes"),
        F.timestamp_seconds(base + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("file_modified_at"))
    return discovered, state


def _j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    discovered, state = _manifest_pairs(spark, sf_dir)
    return changed_files(discovered, state).select("file_path", "file_size", "reason")


def _sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-SQL/J6: free SQL over the registered views (sessions ⋈ tool_calls)."""
    return run_sql(spark, _tables(spark, sf_dir), """
        SELECT s.project_path, t.tool_name, COUNT(*) AS calls,
               SUM(CASE WHEN t.has_error THEN 1 ELSE 0 END) AS errors
        FROM sessions s JOIN tool_calls t ON s.session_id = t.session_id
        WHERE NOT s.is_agent
        GROUP BY s.project_path, t.tool_name""")


def _sql_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with no command invocation (anti join through SQL)."""
    return run_sql(spark, _tables(spark, sf_dir), """
        SELECT s.session_id, s.user_message_count
        FROM sessions s LEFT ANTI JOIN command_invocations c ON s.session_id = c.session_id
        WHERE s.user_message_count > 0""")


def _a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run summary of a full extraction of the corpus (one aggregate
    over the union of three narrow projections; no join)."""
    t = _tables(spark, sf_dir)
    zero, none = F.lit(0), F.lit(None).cast("double")
    cols = ["s", "m", "c", "cost", "uses"]
    parts = [
        t["sessions"].select(F.lit(1).alias("s"), zero.alias("m"), zero.alias("c"),
                             F.col("estimated_total_cost_usd").alias("cost"),
                             F.col("tool_call_count").cast("long").alias("uses")),
        t["messages"].select(zero.alias("s"), F.lit(1).alias("m"), zero.alias("c"), none.alias("cost"),
                             F.lit(0).cast("long").alias("uses")),
        t["tool_calls"].select(zero.alias("s"), zero.alias("m"), F.lit(1).alias("c"), none.alias("cost"),
                               F.lit(0).cast("long").alias("uses")),
    ]
    u = parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))
    return u.agg(F.sum("s").cast("long").alias("sessions"), F.round(F.sum("cost"), 2).alias("cost_usd"),
                 F.sum("uses").alias("tool_uses"), F.sum("m").cast("long").alias("messages"),
                 F.sum("c").cast("long").alias("tool_calls"))


def _w1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 operator on a hot key: position of every event within its user by
    (ts, event_id), cut into hour blocks (no per-user window over all rows)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return dense_position(ev, ["user_id"], ["ts", "event_id"], F.floor(F.unix_seconds("ts") / 3600).cast("long"),
                          out="position").select("event_id", "user_id", "position")


def _d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1 on whole texts: every line of every document read as a transcript
    line and classified by the quarantine rule (blank / not an object /
    malformed JSON); JSON-object lines are kept, so they are not counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    exploded = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("session_id"),
        F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_num", "value"))
    lines = exploded.select(
        F.lit("claude-code").alias("source"),
        F.concat(F.lit("synthetic://documents/"), "session_id", F.lit(".jsonl")).alias("file_path"),
        "session_id", F.lit(False).alias("is_agent"), F.lit("-docs").alias("project_dir_name"),
        F.lit("/docs").alias("project_path"), F.lit(None).cast("long").alias("file_size"),
        F.lit(None).cast("timestamp").alias("file_mtime"), F.lit(0).alias("load_rank"),
        F.col("line_num").cast("long"), "value")
    return (quarantine(lines).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("session_id").alias("files")))


# S12 team map (configuration): users u0-u9 form "eng", u10-u19 form "ops".
TEAMS = {"eng": [f"u{i}" for i in range(10)], "ops": [f"u{i}" for i in range(10, 20)]}


def _per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user daily summaries (the R16 export, agents left out as there). Event
    sessions have their user; conversation n belongs to user n % 40."""
    s = _tables(spark, sf_dir)["sessions"].filter(~F.col("is_agent"))
    number = F.regexp_extract("session_id", r"^conv-(\d+)$", 1)
    user = (F.when(number != "", F.concat(F.lit("u"), (number.try_cast("long") % 40).cast("string")))
            .otherwise(F.split("session_id", "-")[0]))
    return (s.groupBy(user.alias("user"), F.to_date("started_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.round(F.sum("duration_seconds") / F.lit(3600.0), 1).alias("hours"),
                 F.round(F.sum("estimated_total_cost_usd"), 2).alias("cost"),
                 F.sum("user_message_count").alias("messages")))


def _s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries consolidated per team and day with the team map."""
    return team_daily(_per_user(spark, sf_dir), team_map(spark, TEAMS))


def _s12_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries written as CSV for each user, read back and consolidated."""
    folder = scratch_path(spark, "team-exports")
    export_team(_per_user(spark, sf_dir), folder)
    return team_daily(read_team_exports(spark, folder), team_map(spark, TEAMS))


_PIPELINE_ROOTS: dict[tuple, str] = {}


def _pipeline_views(spark: SparkSession, sf_dir: str):
    """S9/S10/I1-I3/J3/W5 end to end: a full run in which 5% of the sessions
    (chosen by a hash of the id) hold only their first two lines and a stale
    size, then an incremental run over the real listing, which finds exactly
    those files changed and re-reads them whole. Runs once per application."""
    apply_engine_conf(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PIPELINE_ROOTS:
        root = scratch_path(spark, "pipeline")
        grown = F.pmod(F.hash("session_id"), F.lit(20)) == 0
        lines = corpus_lines(spark, sf_dir)
        files = corpus_files(spark, sf_dir)
        pipeline.run(spark, pipeline.LinesSource(lines.filter(~grown | (F.col("line_num") < 2)),
                                                 files.withColumn("file_size", F.when(grown, F.lit(1)).cast("long"))),
                     root, mode="full", prices=CORPUS_PRICES)
        refresh(spark, root)   # the sums of what the second run replaces are stored and taken back
        res = pipeline.run(spark, pipeline.LinesSource(lines, files), root, mode="incremental",
                           prices=CORPUS_PRICES)
        if res.files_extracted == 0:
            raise RuntimeError("the incremental run found no changed files")
        _PIPELINE_ROOTS[key] = root
    return pipeline.TableRoot(spark, _PIPELINE_ROOTS[key]).views()


def _stored_report(name: str, **kw) -> Callable[[SparkSession, str], DataFrame]:
    """A report from the sums stored over both runs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _pipeline_views(spark, sf_dir)
        return getattr(StoredReports(spark, _PIPELINE_ROOTS[spark.sparkContext.applicationId, sf_dir]), name)(**kw)
    return run


def _tiered(table: str, drop=()) -> Callable[[SparkSession, str], DataFrame]:
    """A table after its two batches were merged into one of a higher tier (a fanout of two)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _pipeline_views(spark, sf_dir) and pipeline.TableRoot(spark, _PIPELINE_ROOTS[spark.sparkContext.applicationId, sf_dir])
        if not (compact_tiers(spark, store.root, fanout=2, base_bytes=1 << 50) or len(store.live_batches(store.current_generation())) == 1):
            raise RuntimeError("the batches were not merged")
        return store.views()[table].drop(*drop)
    return run


_DISK_RUNS: dict[tuple, tuple[str, dict]] = {}


def _disk_run(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """The corpus written as transcript trees and sidecars in the
    shared scratch folder, then found and read as files by a full run (a large
    corpus a part at a time). Once per application; returns the table root and
    the run's summary."""
    apply_engine_conf(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DISK_RUNS:
        trees, root = scratch_path(spark, "trees"), scratch_path(spark, "disk-tables")
        res = pipeline.run(spark, CorpusTrees(sf_dir, trees), root, mode="full", prices=CORPUS_PRICES)
        _DISK_RUNS[key] = root, res.summary
    return _DISK_RUNS[key]


#: What only files have: their place, size and time. The last two parts of a path are compared.
_FILE_ONLY = ("file_path", "file_size_bytes", "jsonl_modified_at", "extracted_at")


def _disk(table: str, drop=()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pipeline.TableRoot(spark, _disk_run(spark, sf_dir)[0]).views()[table].drop(*drop)


def _tail(path: str):
    return F.regexp_extract(path, r"([^/]+/[^/]+)$", 1).alias("path_tail")


def _disk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _disk("sessions")(spark, sf_dir)
    return s.withColumn("path_tail", _tail("file_path")).drop(*_FILE_ONLY)


def _disk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disk("etl_state")(spark, sf_dir).select("session_id", _tail("file_path"))


def _disk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, D-3: what the job itself reports of the run over files."""
    s = _disk_run(spark, sf_dir)[1]
    keys = ("sessions", "messages", "tool_calls", "skipped_lines", "tool_uses_dropped")
    row = (*[int(s[k]) for k in keys], round(s["cost_usd"], 2))
    return spark.createDataFrame([row], ", ".join(f"{k} long" for k in keys) + ", cost_usd double")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: R13 cost by project over the sf0.001 corpus."""
    return R.r13_cost_by_project(_tables(spark, SMOKE_DIR))


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators, if they are there. A package
    that they need and that is missing is an error like any other."""
    try:
        import corpus_pipeline
        from chatlake.llm.queries import ORACLE_SQL, QUERIES
    except ModuleNotFoundError as exc:
        if exc.name != "corpus_pipeline" and not (exc.name or "").startswith("chatlake.llm"):
            raise
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLE_SQL, **sql}


#: Query of a report from stored sums -> the report and its arguments.
_STORED = {f"stored_{name}": (name, kw) for name, kw in (
    ("r1_session_count", {}), ("r2_sessions_by_source", {}), ("r4_table_counts", {}), ("r5_unique_files", {}), ("r6_token_totals", {}),
    ("r7_model_usage", {}), ("r8_top_commands", {}), ("r9_top_tools", {}), ("r10_sessions_by_project", {}),
    ("r13_cost_by_project", {}), ("r14_tool_ranking", {}), ("r15_model_breakdown", {}),
    ("r16_daily_summary", {"as_of": AS_OF_DAILY, "days": DAILY_DAYS}), ("r17_sessions_by_day", {}), ("r20_command_usage", {}),
    ("r21_cache_by_model", {}), ("r22_most_edited", {}), ("r23_projects_by_sessions", {}))}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_llm()[0],
        # --- the 8 tables (full rows) --------------------------------------
        "a_sessions": _table("sessions", drop=("extracted_at",)),
        "p3_messages": _table("messages"),
        "j1_tool_calls": _table("tool_calls"),
        "f8_command_invocations": _table("command_invocations"),
        "a12_files_referenced": _table("files_referenced"),
        "a11_model_usage": _table("model_usage"),
        "j4_cowork_sessions": _table("cowork_sessions"),
        # --- single operators -------------------------------------------
        "w1_sequence_number": lambda s, d: _tables(s, d)["messages"].select(
            "session_id", "message_id", "sequence_number"),
        "w1_event_positions": _w1_events,
        "f1_timestamps": lambda s, d: _tables(s, d)["messages"].select("message_id", "timestamp"),
        "f4_thinking": lambda s, d: _tables(s, d)["messages"].filter("has_thinking").select(
            "message_id", "thinking_text"),
        "f11_bash_paths": lambda s, d: _tables(s, d)["files_referenced"].filter(
            F.col("operation") == "bash").select("session_id", "file_path", "reference_count"),
        "j2_session_cost": lambda s, d: _tables(s, d)["sessions"].select(
            "session_id", "model", "estimated_input_cost_usd", "estimated_output_cost_usd",
            "estimated_total_cost_usd"),
        "a10_turn_timing": lambda s, d: _tables(s, d)["sessions"].filter(F.col("turn_count") > 0).select(
            "session_id", "total_turn_duration_ms", "avg_turn_duration_ms", "turn_count"),
        # --- rules that transcripts seldom reach ---------------------------
        "p4_rule_messages": _rules("messages", _RULE_MESSAGES),
        "p7_rule_tool_calls": _rules("tool_calls", _RULE_CALLS),
        "f14_rule_commands": _rules("command_invocations"),
        "p6_rule_model_usage": _rules("model_usage"),
        "s11_csv_messages": _csv(_rules("messages", _RULE_MESSAGES)),
        "s11_csv_cowork": _csv(_table("cowork_sessions")),
        "t1_ordered_cowork": _ordered(R.r11_latest_cowork, k=500),
        "t1_ordered_tools": _ordered(R.r9_top_tools),
        "t1_ordered_files": _ordered(R.r22_most_edited, k=500),
        "j3_changed_files": _j3,
        "a14_run_summary": _a14,
        "d1_quarantine_documents": _d1,
        "s12_team_daily": _s12,
        "s12_team_daily_from_files": _s12_files,
        "i1_pipeline_sessions": lambda s, d: _pipeline_views(s, d)["sessions"].drop("extracted_at"),
        "i1_pipeline_messages": lambda s, d: _pipeline_views(s, d)["messages"],
        "i1_pipeline_tool_calls": lambda s, d: _pipeline_views(s, d)["tool_calls"],
        "i1_pipeline_files_referenced": lambda s, d: _pipeline_views(s, d)["files_referenced"],
        "s10_tiered_sessions": _tiered("sessions", drop=("extracted_at",)),
        "s10_tiered_tool_calls": _tiered("tool_calls"),
        "s10_tiered_model_usage": _tiered("model_usage"),
        **{k: _stored_report(name, **kw) for k, (name, kw) in _STORED.items()},
        "s1_disk_sessions": _disk_sessions,
        "s1_disk_messages": _disk("messages"),
        "s1_disk_tool_calls": _disk("tool_calls"),
        "s1_disk_command_invocations": _disk("command_invocations"),
        "s1_disk_files_referenced": _disk("files_referenced"),
        "s1_disk_model_usage": _disk("model_usage"),
        "s3_disk_cowork_sessions": _disk("cowork_sessions"),
        "i3_disk_etl_state": _disk_state,
        "a14_disk_run_summary": _disk_summary,
        "q_sql_project_tools": _sql_join,
        "q_sql_sessions_without_commands": _sql_anti,
        # --- reports ------------------------------------------------------
        "r1_session_count": _report(R.r1_session_count),
        "r2_sessions_by_source": _report(R.r2_sessions_by_source),
        "r3_agent_session_count": _report(R.r3_agent_session_count),
        "r4_table_counts": _report(R.r4_table_counts),
        "r5_unique_files": _report(R.r5_unique_files),
        "r6_token_totals": _report(R.r6_token_totals),
        "r7_model_usage": _report(R.r7_model_usage),
        "r8_top_commands": _report(R.r8_top_commands),
        "r9_top_tools": _report(R.r9_top_tools),
        "r10_sessions_by_project": _report(R.r10_sessions_by_project),
        "r11_latest_cowork": _report(R.r11_latest_cowork),
        "r12_today": _report(R.r12_today, as_of=AS_OF_TODAY),
        "r13_cost_by_project": _report(R.r13_cost_by_project),
        "r14_tool_ranking": _report(R.r14_tool_ranking),
        "r15_model_breakdown": _report(R.r15_model_breakdown),
        "r16_daily_summary": _report(R.r16_daily_summary, as_of=AS_OF_DAILY, days=DAILY_DAYS),
        "r17_sessions_by_day": _report(R.r17_sessions_by_day),
        "r18_most_expensive": _report(R.r18_most_expensive),
        "r19_tool_error_rates": _report(R.r19_tool_error_rates),
        "r20_command_usage": _report(R.r20_command_usage),
        "r21_cache_by_model": _report(R.r21_cache_by_model),
        "r22_most_edited": _report(R.r22_most_edited),
        "r23_projects_by_sessions": _report(R.r23_projects_by_sessions),
        "r24_latest_sessions": lambda s, d: R.r24_latest_sessions(_tables(s, d)).drop("extracted_at"),
    }


_HOURS = "ROUND(CAST(SUM(duration_seconds) AS DOUBLE) / 3600.0, 1)"
_MONEY = "ROUND(SUM(estimated_total_cost_usd), 2)"
def _iso(c: str) -> str:
    return f"""strftime("{c}", '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"""


_ERRS = "COUNT(CASE WHEN has_error THEN 1 END)"


def oracle_sql() -> dict[str, str]:
    sql = _oracle_sql()
    # the same reports from stored sums, the same tables after a merge
    return {**sql, **{k: sql[name] for k, (name, _) in _STORED.items()}, "s10_tiered_sessions": sql["a_sessions"],
            "s10_tiered_tool_calls": sql["j1_tool_calls"], "s10_tiered_model_usage": sql["a11_model_usage"]}


def _oracle_sql() -> dict[str, str]:
    o = oracle
    return {
        **_llm()[1],
        "a_sessions": o("SELECT * FROM o_sessions"),
        "p3_messages": o("SELECT * FROM o_messages"),
        "j1_tool_calls": o("SELECT * FROM o_tool_calls"),
        "f8_command_invocations": o("SELECT * FROM o_commands"),
        "a12_files_referenced": o("SELECT * FROM o_files"),
        "a11_model_usage": o("SELECT * FROM o_model_usage"),
        "j4_cowork_sessions": o("SELECT * FROM o_cowork"),
        "w1_sequence_number": o("SELECT session_id, message_id, sequence_number FROM o_messages"),
        "p4_rule_messages": rules_oracle("SELECT * FROM r_messages"),
        "p7_rule_tool_calls": rules_oracle("SELECT * FROM r_tool_calls"),
        "f14_rule_commands": rules_oracle("SELECT * FROM r_commands"),
        "p6_rule_model_usage": rules_oracle("SELECT * FROM r_model_usage"),
        "s11_csv_messages": rules_oracle("SELECT " + ", ".join(
            f"{_iso(c)} AS {c}" if c == "timestamp" else f"NULLIF(CAST({c} AS VARCHAR), '') AS {c}" for c in _RULE_MESSAGES) + " FROM r_messages"),
        "s11_csv_cowork": o(f"""
            SELECT * REPLACE ({_iso('created_at')} AS created_at, {_iso('last_activity_at')} AS last_activity_at,
                              '["' || user_selected_folders[1] || '"]' AS user_selected_folders, CAST(is_archived AS VARCHAR) AS is_archived)
            FROM o_cowork"""),
        "t1_ordered_cowork": o("""
            SELECT title, created_at, model, row_number() OVER (ORDER BY created_at DESC NULLS LAST, cowork_session_id) - 1 AS place
            FROM o_cowork ORDER BY place LIMIT 500"""),
        "t1_ordered_tools": o(f"""
            SELECT *, row_number() OVER (ORDER BY cnt DESC, tool_name) - 1 AS place FROM
              (SELECT tool_name, COUNT(*) AS cnt, {_ERRS} AS errors FROM o_tool_calls GROUP BY tool_name) ORDER BY place LIMIT 10"""),
        "t1_ordered_files": o("""
            SELECT *, row_number() OVER (ORDER BY refs DESC, file_path) - 1 AS place FROM
              (SELECT file_path, CAST(SUM(reference_count) AS BIGINT) AS refs FROM o_files WHERE operation = 'edit' GROUP BY file_path)
            ORDER BY place LIMIT 500"""),
        "w1_event_positions": """
            SELECT event_id, user_id,
                   CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS position
            FROM events""",
        "f1_timestamps": o('SELECT message_id, "timestamp" FROM o_messages'),
        "f4_thinking": o("SELECT message_id, thinking_text FROM o_messages WHERE has_thinking"),
        "f11_bash_paths": o("SELECT session_id, file_path, reference_count FROM o_files WHERE operation = 'bash'"),
        "j2_session_cost": o("SELECT session_id, model, estimated_input_cost_usd, estimated_output_cost_usd, "
                             "estimated_total_cost_usd FROM o_sessions"),
        "a10_turn_timing": o("SELECT session_id, total_turn_duration_ms, avg_turn_duration_ms, turn_count "
                             "FROM o_sessions WHERE turn_count > 0"),
        "j3_changed_files": f"""
            WITH d AS (SELECT '/data/doc-' || CAST(doc_id AS VARCHAR) || '.jsonl' AS file_path,
                              n_chars AS file_size, {MANIFEST_EPOCH} + doc_id AS mt, doc_id FROM documents),
                 s AS (SELECT file_path, file_size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS ssize,
                              mt + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS smt
                       FROM d WHERE doc_id % 10 <> 0)
            SELECT d.file_path, d.file_size,
                   CASE WHEN s.file_path IS NULL THEN 'new'
                        WHEN s.ssize <> d.file_size THEN 'size'
                        ELSE 'mtime' END AS reason
            FROM d LEFT JOIN s ON d.file_path = s.file_path
            WHERE s.file_path IS NULL OR s.ssize <> d.file_size OR s.smt <> d.mt""",
        "a14_run_summary": o("""
            SELECT (SELECT COUNT(*) FROM o_sessions) AS sessions,
                   (SELECT ROUND(SUM(estimated_total_cost_usd), 2) FROM o_sessions) AS cost_usd,
                   (SELECT CAST(SUM(tool_call_count) AS BIGINT) FROM o_sessions) AS tool_uses,
                   (SELECT COUNT(*) FROM o_messages) AS messages,
                   (SELECT COUNT(*) FROM o_tool_calls) AS tool_calls"""),
        "d1_quarantine_documents": r"""
            WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS v FROM documents),
            c AS (
              SELECT doc_id, CASE
                WHEN regexp_full_match(v, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') THEN 'blank'
                WHEN json_valid(v) AND json_type(v::JSON) = 'OBJECT' THEN NULL
                WHEN json_valid(v) THEN 'not_object'
                ELSE 'malformed_json' END AS reason
              FROM l)
            SELECT reason, COUNT(*) AS lines, COUNT(DISTINCT doc_id) AS files
            FROM c WHERE reason IS NOT NULL GROUP BY reason""",
        "i1_pipeline_sessions": o("SELECT * FROM o_sessions"),
        "i1_pipeline_messages": o("SELECT * FROM o_messages"),
        "i1_pipeline_tool_calls": o("SELECT * FROM o_tool_calls"),
        "i1_pipeline_files_referenced": o("SELECT * FROM o_files"),
        "s1_disk_sessions": o("""
            SELECT * EXCLUDE (file_path, file_size_bytes, jsonl_modified_at)
                     REPLACE (CASE WHEN source = 'cowork' THEN 'cowork://Task ' || split_part(replace(session_id, 'agent-', ''), '-', 2)
                                   ELSE project_path END AS project_path),
                   project_dir_name || '/' || session_id || '.jsonl' AS path_tail
            FROM o_sessions"""),
        "s1_disk_messages": o("SELECT * FROM o_messages"),
        "s1_disk_tool_calls": o("SELECT * FROM o_tool_calls"),
        "s1_disk_command_invocations": o("SELECT * FROM o_commands"),
        "s1_disk_files_referenced": o("SELECT * FROM o_files"),
        "s1_disk_model_usage": o("SELECT * FROM o_model_usage"),
        "s3_disk_cowork_sessions": o("SELECT * FROM o_cowork"),
        "i3_disk_etl_state": o("SELECT session_id, project_dir_name || '/' || session_id || '.jsonl' AS path_tail FROM o_sessions"),
        "a14_disk_run_summary": o("""
            SELECT (SELECT COUNT(*) FROM o_sessions) AS sessions, (SELECT COUNT(*) FROM o_messages) AS messages,
                   (SELECT COUNT(*) FROM o_tool_calls) AS tool_calls, 0 AS skipped_lines, 0 AS tool_uses_dropped,
                   (SELECT ROUND(SUM(estimated_total_cost_usd), 2) FROM o_sessions) AS cost_usd"""),
        "s12_team_daily": o(team_sql := """
            , per_user AS (
              SELECT CASE WHEN starts_with(session_id, 'conv-')
                          THEN 'u' || CAST(CAST(split_part(session_id, '-', 2) AS BIGINT) % 40 AS VARCHAR)
                          ELSE split_part(session_id, '-', 1) END AS "user", CAST(started_at AS DATE) AS day,
                     COUNT(*) AS sessions,
                     ROUND(CAST(SUM(duration_seconds) AS DOUBLE) / 3600.0, 1) AS hours,
                     ROUND(SUM(estimated_total_cost_usd), 2) AS cost,
                     CAST(SUM(user_message_count) AS BIGINT) AS messages
              FROM o_sessions WHERE NOT is_agent GROUP BY 1, 2)
            SELECT COALESCE(CASE WHEN CAST(substr("user", 2) AS INTEGER) < 10 THEN 'eng'
                                 WHEN CAST(substr("user", 2) AS INTEGER) < 20 THEN 'ops' END,
                            'unassigned') AS team,
                   day, COUNT(DISTINCT "user") AS users, CAST(SUM(sessions) AS BIGINT) AS sessions,
                   ROUND(SUM(hours), 1) AS hours, ROUND(SUM(cost), 2) AS cost,
                   CAST(SUM(messages) AS BIGINT) AS messages
            FROM per_user GROUP BY 1, 2"""),
        "s12_team_daily_from_files": o(team_sql),
        "q_sql_project_tools": o("""
            SELECT s.project_path, t.tool_name, COUNT(*) AS calls,
                   CAST(SUM(CASE WHEN t.has_error THEN 1 ELSE 0 END) AS BIGINT) AS errors
            FROM o_sessions s JOIN o_tool_calls t ON s.session_id = t.session_id
            WHERE NOT s.is_agent GROUP BY s.project_path, t.tool_name"""),
        "q_sql_sessions_without_commands": o("""
            SELECT s.session_id, s.user_message_count FROM o_sessions s
            WHERE s.user_message_count > 0
              AND NOT EXISTS (SELECT 1 FROM o_commands c WHERE c.session_id = s.session_id)"""),
        "r1_session_count": o("SELECT COUNT(*) AS sessions FROM o_sessions"),
        "r2_sessions_by_source": o("SELECT COALESCE(source, 'claude-code') AS src, COUNT(*) AS cnt "
                                   "FROM o_sessions GROUP BY 1"),
        "r3_agent_session_count": o("SELECT COUNT(*) AS agent_sessions FROM o_sessions WHERE is_agent"),
        "r4_table_counts": o("""
            SELECT 'messages' AS metric, COUNT(*) AS value FROM o_messages
            UNION ALL SELECT 'tool_calls', COUNT(*) FROM o_tool_calls
            UNION ALL SELECT 'command_invocations', COUNT(*) FROM o_commands"""),
        "r5_unique_files": o("SELECT COUNT(DISTINCT file_path) AS unique_files FROM o_files"),
        "r6_token_totals": o("""
            SELECT CAST(SUM(total_input_tokens) AS BIGINT) AS input_tokens,
                   CAST(SUM(total_output_tokens) AS BIGINT) AS output_tokens,
                   CAST(SUM(total_cache_creation_tokens) AS BIGINT) AS cache_create_tokens,
                   CAST(SUM(total_cache_read_tokens) AS BIGINT) AS cache_read_tokens,
                   ROUND(CAST(SUM(total_cache_read_tokens) AS DOUBLE)
                         / CAST(SUM(total_input_tokens) + SUM(total_cache_creation_tokens)
                                + SUM(total_cache_read_tokens) AS DOUBLE) * 100.0, 1) AS cache_hit_pct,
                   ROUND(SUM(estimated_total_cost_usd), 2) AS est_total_cost
            FROM o_sessions"""),
        "r7_model_usage": o("""
            SELECT model, CAST(SUM(message_count) AS BIGINT) AS msgs,
                   CAST(SUM(total_input_tokens) + SUM(total_cache_creation_tokens)
                        + SUM(total_cache_read_tokens) AS BIGINT) AS all_input,
                   CAST(SUM(total_output_tokens) AS BIGINT) AS out_tokens
            FROM o_model_usage GROUP BY model"""),
        "r8_top_commands": o("""
            SELECT command_name, is_skill, COUNT(*) AS cnt FROM o_commands
            GROUP BY command_name, is_skill ORDER BY cnt DESC, command_name, is_skill LIMIT 10"""),
        "r9_top_tools": o(f"""
            SELECT tool_name, COUNT(*) AS cnt, {_ERRS} AS errors FROM o_tool_calls
            GROUP BY tool_name ORDER BY cnt DESC, tool_name LIMIT 10"""),
        "r10_sessions_by_project": o(f"""
            SELECT project_path, COUNT(*) AS cnt, {_MONEY} AS cost
            FROM o_sessions WHERE NOT is_agent GROUP BY project_path"""),
        "r11_latest_cowork": o("""
            SELECT title, created_at, model FROM o_cowork
            ORDER BY created_at DESC NULLS LAST, cowork_session_id LIMIT 10"""),
        "r12_today": o(f"""
            SELECT session_id, project_path, model, started_at,
                   CAST(duration_seconds // 60 AS BIGINT) AS minutes,
                   estimated_total_cost_usd AS cost, user_message_count AS msgs,
                   tool_call_count AS tools
            FROM o_sessions WHERE started_at >= TIMESTAMP '{AS_OF_TODAY}' AND NOT is_agent"""),
        "r13_cost_by_project": o(f"""
            SELECT project_path, COUNT(*) AS sessions, {_MONEY} AS total_cost, {_HOURS} AS total_hours
            FROM o_sessions WHERE NOT is_agent GROUP BY project_path"""),
        "r14_tool_ranking": o(f"""
            SELECT tool_name, COUNT(*) AS uses, {_ERRS} AS errors,
                   ROUND(CAST({_ERRS} AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE), 1) AS error_pct
            FROM o_tool_calls GROUP BY tool_name"""),
        "r15_model_breakdown": o("""
            SELECT model, CAST(SUM(message_count) AS BIGINT) AS messages,
                   CAST(SUM(total_input_tokens + total_cache_creation_tokens + total_cache_read_tokens) AS BIGINT) AS input_tokens,
                   CAST(SUM(total_output_tokens) AS BIGINT) AS output_tokens
            FROM o_model_usage GROUP BY model"""),
        "r16_daily_summary": o(f"""
            SELECT CAST(started_at AS DATE) AS day, COUNT(*) AS sessions, {_HOURS} AS hours,
                   {_MONEY} AS cost, CAST(SUM(user_message_count) AS BIGINT) AS messages
            FROM o_sessions
            WHERE started_at >= TIMESTAMP '{AS_OF_DAILY}' - INTERVAL {DAILY_DAYS} DAY AND NOT is_agent
            GROUP BY 1"""),
        "r17_sessions_by_day": o(f"""
            SELECT CAST(started_at AS DATE) AS day, COUNT(*) AS sessions, {_MONEY} AS cost, {_HOURS} AS hours
            FROM o_sessions WHERE NOT is_agent GROUP BY 1 ORDER BY day DESC LIMIT 14"""),
        "r18_most_expensive": o("""
            SELECT session_id, project_path, model, ROUND(estimated_total_cost_usd, 2) AS cost,
                   CAST(duration_seconds // 60 AS BIGINT) AS minutes
            FROM o_sessions ORDER BY estimated_total_cost_usd DESC, session_id LIMIT 10"""),
        "r19_tool_error_rates": o(f"""
            SELECT tool_name, COUNT(*) AS total, {_ERRS} AS errors,
                   ROUND(CAST({_ERRS} AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE), 1) AS error_pct
            FROM o_tool_calls GROUP BY tool_name"""),
        "r20_command_usage": o("""
            SELECT command_name, is_skill, COUNT(*) AS times_used FROM o_commands
            GROUP BY command_name, is_skill"""),
        "r21_cache_by_model": o("""
            SELECT model, COUNT(*) AS sessions, ROUND(AVG(cache_hit_rate) * 100.0, 1) AS avg_cache_pct
            FROM o_sessions WHERE cache_hit_rate IS NOT NULL GROUP BY model"""),
        "r22_most_edited": o("""
            SELECT file_path, CAST(SUM(reference_count) AS BIGINT) AS refs FROM o_files
            WHERE operation = 'edit' GROUP BY file_path ORDER BY refs DESC, file_path LIMIT 20"""),
        "r23_projects_by_sessions": o("""
            SELECT project_path, COUNT(*) AS sessions FROM o_sessions GROUP BY project_path"""),
        "r24_latest_sessions": o("""
            SELECT * FROM o_sessions ORDER BY started_at DESC NULLS LAST, session_id LIMIT 5"""),
    }
