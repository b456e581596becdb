"""The reference's reports as DataFrame functions over the tables.

Every function takes ``t`` (a mapping of table name -> DataFrame, e.g. the
current views of a table root) and returns a lazy DataFrame; nothing is
collected. Sort keys of the reference are not unique, so each ordering
gets the group key as a tie-breaker; top-k uses ``orderBy().limit()``,
which Spark plans as a per-partition top-k (``TakeOrderedAndProject``).
Doubles summed in any order are rounded as the reference displays them.
Time filters take an explicit ``as_of`` date instead of reading the clock.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict


def _cnt(name: str):
    return F.count(F.lit(1)).alias(name)


def _not_agent(df: DataFrame) -> DataFrame:
    """Interactive sessions only."""
    return df.filter(~F.col("is_agent"))


def _hours(c: str = "duration_seconds"):
    return F.round(F.sum(c) / F.lit(3600.0), 1)


def _money(c: str = "estimated_total_cost_usd"):
    return F.round(F.sum(c), 2)


def _date_lit(d) -> F.Column:
    return F.lit(str(d)).cast("date").cast("timestamp")


# ---------------------------------------------------------------- statistics
def r1_session_count(t: Tables) -> DataFrame:
    return t["sessions"].agg(_cnt("sessions"))


def r2_sessions_by_source(t: Tables) -> DataFrame:
    src = F.coalesce("source", F.lit("claude-code")).alias("src")
    return t["sessions"].groupBy(src).agg(_cnt("cnt")).orderBy(F.desc("cnt"), "src")


def r3_agent_session_count(t: Tables) -> DataFrame:
    return t["sessions"].filter(F.col("is_agent")).agg(_cnt("agent_sessions"))


def r4_table_counts(t: Tables) -> DataFrame:
    """Message, tool-call and command counts as (metric, value) rows."""
    parts = [t[name].agg(F.lit(label).alias("metric"), F.count(F.lit(1)).alias("value"))
             for name, label in (("messages", "messages"), ("tool_calls", "tool_calls"),
                                 ("command_invocations", "command_invocations"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def r5_unique_files(t: Tables, approx: bool = False) -> DataFrame:
    """Distinct files touched; ``approx=True`` uses HyperLogLog++ at scale."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return t["files_referenced"].agg(f("file_path").alias("unique_files"))


def r6_token_totals(t: Tables) -> DataFrame:
    s = t["sessions"]
    tot = s.agg(*[F.sum(c).alias(c) for c in (
        "total_input_tokens", "total_output_tokens", "total_cache_creation_tokens",
        "total_cache_read_tokens")], F.sum("estimated_total_cost_usd").alias("cost"))
    all_in = F.col("total_input_tokens") + F.col("total_cache_creation_tokens") + F.col("total_cache_read_tokens")
    return tot.select(
        F.col("total_input_tokens").alias("input_tokens"),
        F.col("total_output_tokens").alias("output_tokens"),
        F.col("total_cache_creation_tokens").alias("cache_create_tokens"),
        F.col("total_cache_read_tokens").alias("cache_read_tokens"),
        F.when(all_in > 0, F.round(F.col("total_cache_read_tokens").cast("double") / all_in.cast("double") * F.lit(100.0), 1))
        .alias("cache_hit_pct"),
        F.round("cost", 2).alias("est_total_cost"))


def r7_model_usage(t: Tables) -> DataFrame:
    return (t["model_usage"].groupBy("model").agg(
        F.sum("message_count").alias("msgs"),
        (F.sum("total_input_tokens") + F.sum("total_cache_creation_tokens")
         + F.sum("total_cache_read_tokens")).alias("all_input"),
        F.sum("total_output_tokens").alias("out_tokens"))
        .orderBy(F.desc("msgs"), "model"))


def r8_top_commands(t: Tables, k: int = 10) -> DataFrame:
    return (t["command_invocations"].groupBy("command_name", "is_skill").agg(_cnt("cnt"))
            .orderBy(F.desc("cnt"), "command_name", "is_skill").limit(k))


def r9_top_tools(t: Tables, k: int = 10) -> DataFrame:
    return (t["tool_calls"].groupBy("tool_name")
            .agg(_cnt("cnt"), F.count_if("has_error").alias("errors"))
            .orderBy(F.desc("cnt"), "tool_name").limit(k))


def r10_sessions_by_project(t: Tables) -> DataFrame:
    return (_not_agent(t["sessions"]).groupBy("project_path")
            .agg(_cnt("cnt"), _money().alias("cost"))
            .orderBy(F.desc("cnt"), "project_path"))


def r11_latest_cowork(t: Tables, k: int = 10) -> DataFrame:
    return (t["cowork_sessions"]
            .orderBy(F.desc_nulls_last("created_at"), "cowork_session_id").limit(k)
            .select("title", "created_at", "model"))


# ---------------------------------------------------------------- canned reports
def r12_today(t: Tables, as_of) -> DataFrame:
    """Sessions started on or after ``as_of`` (the reference uses today's date)."""
    return (_not_agent(t["sessions"]).filter(F.col("started_at") >= _date_lit(as_of))
            .select("session_id", "project_path", "model", "started_at",
                    F.expr("duration_seconds div 60").alias("minutes"),
                    F.col("estimated_total_cost_usd").alias("cost"),
                    F.col("user_message_count").alias("msgs"),
                    F.col("tool_call_count").alias("tools"))
            .orderBy("started_at", "session_id"))


def r13_cost_by_project(t: Tables) -> DataFrame:
    return (_not_agent(t["sessions"]).groupBy("project_path")
            .agg(_cnt("sessions"), _money().alias("total_cost"), _hours().alias("total_hours"))
            .orderBy(F.desc("total_cost"), "project_path"))


def r14_tool_ranking(t: Tables) -> DataFrame:
    g = t["tool_calls"].groupBy("tool_name").agg(_cnt("uses"), F.count_if("has_error").alias("errors"))
    return (g.withColumn("error_pct", F.round(F.col("errors") * F.lit(100.0) / F.col("uses"), 1))
            .orderBy(F.desc("uses"), "tool_name"))


def r15_model_breakdown(t: Tables) -> DataFrame:
    mu = t["model_usage"]
    return (mu.groupBy("model").agg(
        F.sum("message_count").alias("messages"),
        F.sum(F.col("total_input_tokens") + F.col("total_cache_creation_tokens")
              + F.col("total_cache_read_tokens")).alias("input_tokens"),
        F.sum("total_output_tokens").alias("output_tokens"))
        .orderBy(F.desc("messages"), "model"))


def r16_daily_summary(t: Tables, as_of, days: int) -> DataFrame:
    """Per day since ``as_of - days``: sessions, hours, cost, user messages."""
    cutoff = _dt.date.fromisoformat(str(as_of)) - _dt.timedelta(days=days)
    return (_not_agent(t["sessions"]).filter(F.col("started_at") >= _date_lit(cutoff))
            .groupBy(F.to_date("started_at").alias("day"))
            .agg(_cnt("sessions"), _hours().alias("hours"), _money().alias("cost"),
                 F.sum("user_message_count").alias("messages"))
            .orderBy(F.desc("day")))


# ---------------------------------------------------------------- README queries
def r17_sessions_by_day(t: Tables, k: int = 14) -> DataFrame:
    return (_not_agent(t["sessions"]).groupBy(F.to_date("started_at").alias("day"))
            .agg(_cnt("sessions"), _money().alias("cost"), _hours().alias("hours"))
            .orderBy(F.desc("day")).limit(k))


def r18_most_expensive(t: Tables, k: int = 10) -> DataFrame:
    return (t["sessions"].orderBy(F.desc("estimated_total_cost_usd"), "session_id").limit(k)
            .select("session_id", "project_path", "model",
                    F.round("estimated_total_cost_usd", 2).alias("cost"),
                    F.expr("duration_seconds div 60").alias("minutes")))


def r19_tool_error_rates(t: Tables) -> DataFrame:
    return r14_tool_ranking(t).withColumnRenamed("uses", "total")


def r20_command_usage(t: Tables) -> DataFrame:
    return (t["command_invocations"].groupBy("command_name", "is_skill")
            .agg(_cnt("times_used")).orderBy(F.desc("times_used"), "command_name", "is_skill"))


def r21_cache_by_model(t: Tables) -> DataFrame:
    return (t["sessions"].filter(F.col("cache_hit_rate").isNotNull()).groupBy("model")
            .agg(_cnt("sessions"), F.round(F.avg("cache_hit_rate") * F.lit(100.0), 1).alias("avg_cache_pct"))
            .orderBy("model"))


def r22_most_edited(t: Tables, k: int = 20) -> DataFrame:
    return (t["files_referenced"].filter(F.col("operation") == "edit").groupBy("file_path")
            .agg(F.sum("reference_count").alias("refs"))
            .orderBy(F.desc("refs"), "file_path").limit(k))


def r23_projects_by_sessions(t: Tables) -> DataFrame:
    return (t["sessions"].groupBy("project_path").agg(_cnt("sessions"))
            .orderBy(F.desc("sessions"), "project_path"))


def r24_latest_sessions(t: Tables, k: int = 5) -> DataFrame:
    return t["sessions"].orderBy(F.desc_nulls_last("started_at"), "session_id").limit(k)


def stats(t: Tables) -> dict[str, DataFrame]:
    """Entry point C (``--stats``): the statistics block as DataFrames."""
    return {
        "sessions": r1_session_count(t), "by_source": r2_sessions_by_source(t),
        "agent_sessions": r3_agent_session_count(t), "counts": r4_table_counts(t),
        "unique_files": r5_unique_files(t), "tokens": r6_token_totals(t),
        "models": r7_model_usage(t), "commands": r8_top_commands(t),
        "tools": r9_top_tools(t), "projects": r10_sessions_by_project(t),
        "cowork": r11_latest_cowork(t),
    }
