"""R1-R10, R13-R17, R19-R23 from stored sums that follow the batches.

``refresh`` compares the sessions' current versions with those that are already
counted and writes the difference: the sums of new versions, and with a minus sign those of
versions that were replaced since. A report adds the stored rows up and never reads the
fact tables::

    <root>/<gen>/partials/<part>/refresh_id=<r>/     sums by key, signed
    <root>/<gen>/partials/versions/refresh_id=<r>/   sessions' versions counted (+1) or taken back (-1); written last

A version is a session and the time of the run that extracted it, which merged
batches keep; so a refresh reads the new batches and, of the old, those with
replaced sessions, some columns each. A refresh that fails leaves rows that no
reader sees, as only refreshes with a ``versions`` folder count. Each refresh adds a folder
to each part; ``pipeline.compact`` starts a generation whose first refresh sums anew.

Sums are exact: counts and tokens are integers, amounts decimals with 18 places, so what is
taken back leaves nothing behind. NULL is left out of a sum and counted apart, so a
sum over NULLs alone is NULL. Amounts that no such decimal can hold (NaN, 1e20 and
more) count as NULL.

Tool-call ids that several sessions have are counted by first_call_wins over these
calls alone, again at each refresh; an id that becomes shared is taken out of the sums.

Distinct files have two forms: exact, from sums by file, and a HyperLogLog sketch for each
run's sessions that readers merge. A sketch cannot give files back, so the
sketches of runs with replaced sessions are built again, from these runs' rows.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import LazyTables, first_call_wins
from ..session import apply_engine_conf
from ..sources import transcripts as T
from .pipeline import FEW_REPLACED, TableRoot, shared_ids

_MONEY = "decimal(38,18)"
#: 2^14 registers: a standard error of some 0.8 %.
SKETCH_BITS = 14
_TOKENS = ("total_input_tokens", "total_output_tokens", "total_cache_creation_tokens", "total_cache_read_tokens")


def _amount(c: str) -> Column:
    return F.col(c).try_cast(_MONEY)


def _whole(c: str) -> Column:
    return F.col(c).cast("long")


#: part -> (table, columns or expressions of the key, measures)
PARTS: dict[str, tuple[str, dict[str, Column | str], dict]] = {
    "by_session": ("sessions",
                   {"project_dir_name": "project_dir_name", "project_path": "project_path", "source": "source",
                    "is_agent": "is_agent", "model": "model", "day": "to_date(started_at)"},
                   {**{c: _whole for c in (*_TOKENS, "user_message_count", "duration_seconds")},
                    "estimated_total_cost_usd": _amount, "cache_hit_rate": _amount}),
    "by_message": ("messages", {}, {}),
    "by_tool": ("tool_calls", {"tool_name": "tool_name", "has_error": "coalesce(has_error, false)"}, {}),
    "by_command": ("command_invocations", {"command_name": "command_name", "is_skill": "is_skill"}, {}),
    "by_file": ("files_referenced", {"file_path": "file_path", "operation": "operation"}, {"reference_count": _whole}),
    "by_model": ("model_usage", {"model": "model"}, {c: _whole for c in ("message_count", *_TOKENS)}),
}


def _summed(rows: DataFrame, part: str) -> DataFrame:
    """Sums by key of rows with a column ``_sign``."""
    _, keys, measures = PARTS[part]
    sign = F.col("_sign")
    rows = rows.select(*[F.expr(e).alias(k) for k, e in keys.items()], *[f(m).alias(m) for m, f in measures.items()], "_sign")
    sums = [F.sum(sign).alias("_rows")]
    for m, f in measures.items():
        kind = _MONEY if f is _amount else "long"
        sums += [F.coalesce(F.sum(F.when(sign < 0, -F.col(m)).otherwise(F.col(m))), F.lit(0)).cast(kind).alias(m),
                 F.sum(F.when(F.col(m).isNotNull(), sign).otherwise(F.lit(0).cast("long"))).alias(f"{m}_n")]
    return rows.groupBy(*keys).agg(*sums)


def _home(store: TableRoot, gen: str) -> str:
    return f"{store.root}/{gen}/partials"


def _refreshes(store: TableRoot, gen: str) -> list[str]:
    """Finished refreshes, oldest first."""
    home = f"{_home(store, gen)}/versions"
    return sorted(n.split("=", 1)[1] for n in store._names(home)
                  if n.startswith("refresh_id=") and "_SUCCESS" in store._names(f"{home}/{n}"))


def _stored(store: TableRoot, gen: str, part: str, refreshes: list[str]) -> DataFrame:
    home = f"{_home(store, gen)}/{part}"
    paths = [f"{home}/refresh_id={r}" for r in refreshes]
    return store.spark.read.option("basePath", home).parquet(*paths)


def is_kept(store: TableRoot, gen: str) -> bool:
    """Whether this generation has stored sums."""
    return bool(_refreshes(store, gen))


def _counted(store: TableRoot, gen: str, refreshes: list[str]) -> DataFrame:
    """The versions that the stored sums hold."""
    if not refreshes:
        return store.spark.createDataFrame([], "session_id string, extracted_at timestamp")
    return (_stored(store, gen, "versions", refreshes).groupBy("session_id", "extracted_at")
            .agg(F.sum("_sign").alias("n")).filter("n > 0").drop("n"))


def refresh(spark: SparkSession, root: str) -> str | None:
    """Brings the stored sums up to the current views. Returns the refresh's id; None if nothing has changed."""
    apply_engine_conf(spark)
    store = TableRoot(spark, root)
    gen = store.current_generation()
    if gen is None:
        raise FileNotFoundError(f"no table generation under {root}")
    done = _refreshes(store, gen)
    # in order of time, and of the refreshes before
    rid = f"r{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}"
    home = _home(store, gen)

    def write(df: DataFrame, part: str) -> DataFrame:
        path = f"{home}/{part}/refresh_id={rid}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    # where each version's rows are: a version replaced in the views keeps its manifest row
    at = store.manifest(gen).groupBy("session_id", "extracted_at").agg(F.max("batch_id").alias("batch_id"))
    now = at.groupBy("session_id").agg(F.max("batch_id").alias("batch_id")).join(at, ["session_id", "batch_id"])
    # a merged batch has the manifest rows of all versions it took in, but the rows of the last alone
    now = now.groupBy("session_id", "batch_id").agg(F.max("extracted_at").alias("extracted_at"))
    had = _counted(store, gen, done)
    plus = now.join(had, ["session_id", "extracted_at"], "left_anti").withColumn("_sign", F.lit(1).cast("long"))
    minus = (had.join(now, ["session_id", "extracted_at"], "left_anti").join(at, ["session_id", "extracted_at"], "left")
             .withColumn("_sign", F.lit(-1).cast("long")))
    changes = plus.unionByName(minus)
    if changes.isEmpty():
        return None
    delta = write(changes, "changes")
    batches = [r[0] for r in delta.select("batch_id").distinct().collect()]
    if None in batches:
        raise RuntimeError(f"versions counted under {home} have no batch any more; remove the folder and refresh")
    few = F.broadcast(delta) if delta.count() <= FEW_REPLACED else delta

    def rows(table: str) -> DataFrame:
        here = store.read(gen, table).filter(F.col("batch_id").isin(batches)).drop("extracted_at")
        return here.join(few, ["session_id", "batch_id"])

    for part, (table, _, _) in PARTS.items():
        if part != "by_tool":
            write(_summed(rows(table), part), part)
    _write_tools(store, gen, done, rows("tool_calls"), now, few, write)
    _write_sketches(store, gen, delta, now, write)
    write(delta.select("session_id", "extracted_at", "_sign"), "versions")
    return rid


def _ids(ids: DataFrame) -> tuple[DataFrame, int]:
    n = ids.count()
    return (F.broadcast(ids) if n <= FEW_REPLACED else ids), n


def _write_tools(store, gen, done, changed, now, delta, write) -> None:
    """Sums of the calls whose id one session has, and the shared ones as first_call_wins has them now."""
    shared, n = _ids(write(shared_ids(store, gen), "shared"))
    before = _ids(_stored(store, gen, "shared", done[-1:]).select("tool_call_id"))[0] if done else None
    added = changed.filter("_sign > 0").join(shared, "tool_call_id", "left_anti")
    taken = changed.filter("_sign < 0")
    if before is not None:
        taken = taken.join(before, "tool_call_id", "left_anti")
    parts = added.unionByName(taken)
    calls = store.read(gen, "tool_calls").filter(F.col("batch_id").isin(store.live_batches(gen)))
    if n and before is not None:
        new, m = _ids(shared.join(before, "tool_call_id", "left_anti"))
        if m:
            stay = now.join(delta.select("session_id"), "session_id", "left_anti")
            out = (calls.join(new, "tool_call_id", "left_semi").join(stay, ["session_id", "batch_id"], "left_semi")
                   .withColumn("_sign", F.lit(-1).cast("long")))
            parts = parts.unionByName(out, allowMissingColumns=True)
    write(_summed(parts, "by_tool"), "by_tool")
    several = calls.join(shared, "tool_call_id", "left_semi").join(now, ["session_id", "batch_id"], "left_semi")
    write(_summed(first_call_wins(several).withColumn("_sign", F.lit(1).cast("long")), "by_tool"), "by_shared_tool")


def _write_sketches(store, gen, delta, now, write) -> None:
    """The sketch of each run whose sessions changed, from those that are current; NULL once it has none."""
    touched = delta.select("extracted_at").distinct()
    keep = now.join(F.broadcast(touched), "extracted_at", "left_semi")
    batches = [r[0] for r in keep.select("batch_id").distinct().collect()]
    files = store.read(gen, "files_referenced").filter(F.col("batch_id").isin(batches)).select("session_id", "batch_id", "file_path")
    made = (files.join(keep, ["session_id", "batch_id"]).groupBy("extracted_at")
            .agg(F.hll_sketch_agg("file_path", SKETCH_BITS).alias("sketch")))
    write(touched.join(made, "extracted_at", "left"), "file_sketches")


class StoredReports:
    """The reports over the stored sums, as of the last finished refresh.

    Columns, rounding and order are those of ``plans.reports``."""

    def __init__(self, spark: SparkSession, root: str, up_to_date: bool = True):
        if up_to_date:
            refresh(spark, root)
        self.store = TableRoot(spark, root)
        self.gen = self.store.current_generation()
        self.done = _refreshes(self.store, self.gen) if self.gen else []
        if not self.done:
            raise FileNotFoundError(f"no stored sums under {root}")
        self.t = LazyTables({p: (lambda p=p: self._part(p)) for p in PARTS})

    def _part(self, part: str) -> DataFrame:
        rows = _stored(self.store, self.gen, part, self.done).drop("refresh_id")
        if part == "by_tool":
            rows = rows.unionByName(_stored(self.store, self.gen, "by_shared_tool", self.done[-1:]).drop("refresh_id"))
        return rows

    def _sums(self, part: str, keys: dict[str, Column | str], measures=(), rows: DataFrame | None = None) -> DataFrame:
        """Sums by ``keys`` with ``cnt``; groups that were taken back whole are left out."""
        rows = self.t[part] if rows is None else rows
        out = rows.groupBy(*[(F.col(e) if isinstance(e, str) else e).alias(k) for k, e in keys.items()]).agg(
            F.coalesce(F.sum("_rows"), F.lit(0).cast("long")).alias("cnt"),
            *[F.when(F.sum(f"{m}_n") > 0, F.sum(m)).alias(m) for m in measures])
        return out.filter("cnt > 0") if keys else out

    def _sessions(self) -> DataFrame:
        """Sums of sessions under their project's path as any batch has seen it."""
        rows, seen = self.t["by_session"], self.store.project_paths(self.gen)
        return (rows.join(seen, "project_dir_name", "left")
                .withColumn("project_path", F.when(F.col("source") == T.CODE, F.coalesce("_seen_cwd", "project_path")).otherwise(F.col("project_path"))))

    def _interactive(self) -> DataFrame:
        return self._sessions().filter(~F.col("is_agent"))

    @staticmethod
    def _cost(c: str = "estimated_total_cost_usd") -> Column:
        return F.round(F.col(c).cast("double"), 2)

    @staticmethod
    def _hours() -> Column:
        return F.round(F.col("duration_seconds") / F.lit(3600.0), 1)

    def r1_session_count(self):
        return self._sums("by_session", {}).withColumnRenamed("cnt", "sessions")

    def r2_sessions_by_source(self):
        return self._sums("by_session", {"src": F.coalesce("source", F.lit("claude-code"))}).orderBy(F.desc("cnt"), "src")

    def r3_agent_session_count(self):
        return self._sums("by_session", {}, rows=self.t["by_session"].filter("is_agent")).withColumnRenamed("cnt", "agent_sessions")

    def r4_table_counts(self):
        parts = [self._sums(p, {}).select(F.lit(label).alias("metric"), F.col("cnt").alias("value"))
                 for p, label in (("by_message", "messages"), ("by_tool", "tool_calls"), ("by_command", "command_invocations"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def r5_unique_files(self, approx: bool = False):
        if not approx:
            return self._sums("by_file", {"file_path": "file_path"}).agg(F.count("file_path").alias("unique_files"))
        last = (_stored(self.store, self.gen, "file_sketches", self.done).groupBy("extracted_at")
                .agg(F.max_by(F.struct("sketch"), "refresh_id").alias("s")).select("s.sketch").filter("sketch IS NOT NULL"))
        return last.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("unique_files"))

    def r6_token_totals(self):
        s = self._sums("by_session", {}, (*_TOKENS, "estimated_total_cost_usd"))
        read = F.col("total_cache_read_tokens")
        every = F.col("total_input_tokens") + F.col("total_cache_creation_tokens") + read
        return s.select(F.col("total_input_tokens").alias("input_tokens"), F.col("total_output_tokens").alias("output_tokens"),
                        F.col("total_cache_creation_tokens").alias("cache_create_tokens"), read.alias("cache_read_tokens"),
                        F.when(every > 0, F.round(read.cast("double") / every.cast("double") * F.lit(100.0), 1)).alias("cache_hit_pct"),
                        self._cost().alias("est_total_cost"))

    def _models(self, count: str, tokens: str, out: str):
        s = self._sums("by_model", {"model": "model"}, ("message_count", *_TOKENS))
        every = F.col("total_input_tokens") + F.col("total_cache_creation_tokens") + F.col("total_cache_read_tokens")
        return s.select("model", F.col("message_count").alias(count), every.alias(tokens),
                        F.col("total_output_tokens").alias(out)).orderBy(F.desc(count), "model")

    def r7_model_usage(self):
        return self._models("msgs", "all_input", "out_tokens")

    def r8_top_commands(self, k: int = 10):
        return (self._sums("by_command", {"command_name": "command_name", "is_skill": "is_skill"})
                .orderBy(F.desc("cnt"), "command_name", "is_skill").limit(k))

    def _tools(self):
        errors = F.coalesce(F.sum(F.when(F.col("has_error"), F.col("_rows"))), F.lit(0).cast("long"))
        return self.t["by_tool"].groupBy("tool_name").agg(F.sum("_rows").alias("cnt"), errors.alias("errors")).filter("cnt > 0")

    def r9_top_tools(self, k: int = 10):
        return self._tools().orderBy(F.desc("cnt"), "tool_name").limit(k)

    def r10_sessions_by_project(self):
        s = self._sums("by_session", {"project_path": "project_path"}, ("estimated_total_cost_usd",), self._interactive())
        return s.select("project_path", "cnt", self._cost().alias("cost")).orderBy(F.desc("cnt"), "project_path")

    def r13_cost_by_project(self):
        s = self._sums("by_session", {"project_path": "project_path"}, ("estimated_total_cost_usd", "duration_seconds"), self._interactive())
        return (s.select("project_path", F.col("cnt").alias("sessions"), self._cost().alias("total_cost"), self._hours().alias("total_hours"))
                .orderBy(F.desc("total_cost"), "project_path"))

    def r14_tool_ranking(self):
        return (self._tools().withColumn("error_pct", F.round(F.col("errors") * F.lit(100.0) / F.col("cnt"), 1))
                .withColumnRenamed("cnt", "uses").orderBy(F.desc("uses"), "tool_name"))

    def r15_model_breakdown(self):
        return self._models("messages", "input_tokens", "output_tokens")

    def _days(self, rows: DataFrame):
        s = self._sums("by_session", {"day": "day"}, ("duration_seconds", "estimated_total_cost_usd", "user_message_count"), rows)
        return s.select("day", F.col("cnt").alias("sessions"), self._hours().alias("hours"), self._cost().alias("cost"),
                        F.col("user_message_count").alias("messages")).orderBy(F.desc("day"))

    def r16_daily_summary(self, as_of, days: int):
        cutoff = _dt.date.fromisoformat(str(as_of)) - _dt.timedelta(days=days)
        return self._days(self._interactive().filter(F.col("day") >= F.lit(cutoff)))

    def r17_sessions_by_day(self, k: int = 14):
        return self._days(self._interactive()).select("day", "sessions", "cost", "hours").limit(k)

    def r19_tool_error_rates(self):
        return self.r14_tool_ranking().withColumnRenamed("uses", "total")

    def r20_command_usage(self):
        return (self._sums("by_command", {"command_name": "command_name", "is_skill": "is_skill"})
                .withColumnRenamed("cnt", "times_used").orderBy(F.desc("times_used"), "command_name", "is_skill"))

    def r21_cache_by_model(self):
        s = self.t["by_session"].groupBy("model").agg(F.sum("cache_hit_rate_n").alias("sessions"), F.sum("cache_hit_rate").alias("rate"))
        return (s.filter("sessions > 0")
                .select("model", "sessions", F.round(F.col("rate").cast("double") / F.col("sessions") * F.lit(100.0), 1).alias("avg_cache_pct"))
                .orderBy("model"))

    def r22_most_edited(self, k: int = 20):
        s = self._sums("by_file", {"file_path": "file_path"}, ("reference_count",), self.t["by_file"].filter("operation = 'edit'"))
        return s.select("file_path", F.col("reference_count").alias("refs")).orderBy(F.desc("refs"), "file_path").limit(k)

    def r23_projects_by_sessions(self):
        s = self._sums("by_session", {"project_path": "project_path"}, rows=self._sessions())
        return s.withColumnRenamed("cnt", "sessions").orderBy(F.desc("sessions"), "project_path")
