"""The extraction job and its table root.

Storage (plain Parquet, no MERGE needed)::

    <root>/_current/<gen>                 a pointer for each finished generation
    <root>/<gen>/bronze/batch_id=<b>/     parsed entries of batch b
    <root>/<gen>/<table>/batch_id=<b>/    rows of the 8 tables written by b
    <root>/<gen>/quarantine/batch_id=<b>/ skipped lines with a reason
    <root>/<gen>/_chosen/batch_id=<b>/part=<n>/ the files of part n of b's source, also _sidecars/ if it has parts
    <root>/<gen>/shared_calls/batch_id=<b>/ tool-call ids that b found in several sessions
    <root>/<gen>/merged/batch_id=<b>/     the batches whose rows b has taken over (plans/tiers.py)
    <root>/<gen>/partials/<part>/…        stored sums for the reports (plans/partials.py)

Every batch only *appends* its own partition (written with overwrite, so a
retried batch replaces exactly its own files). ``etl_state`` (the manifest)
is written last, as the reference commits its state last: a crash before it
leaves rows no view shows, and the files are picked up again next run.

The *current view* of a per-session table keeps the rows of the batch that
holds the latest winning manifest row of the session: re-extracting a
changed file replaces the whole session, as the reference's delete+insert
does. A full run (S10) writes a new generation and then adds its pointer;
pointers are never changed, and the one with the latest name is in use, so
readers never see a half-built generation. Tool-call ids that several sessions
have, and project folders whose path another batch has seen, are resolved in
the view, so that its rows do not depend on how files were dealt to batches.
Which ids these are each batch writes down, so that the view need not shuffle
the other calls.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.pricing import price_table
from ..operators.cowork import build_cowork_sessions
from ..operators.parse import parse_lines, quarantine_of
from ..operators.tables import LOAD_ORDER, LazyTables, build_files_referenced, build_tables, first_call_wins, session_tool_calls
from ..session import apply_engine_conf, joins_by_seen_size, shuffles_freed
from ..sources import transcripts as T
from .incremental import changed_files

SESSION_TABLES = schemas.SESSION_TABLES
#: (Session, batch) pairs that later batches replaced up to which these are
#: broadcast to the readers of the views; beyond it they are joined by shuffle.
FEW_REPLACED = 1_000_000
#: Rows of a run's small tables (files that went, project folders) up to which they are broadcast.
FEW_ROWS = 100_000


def new_batch_id(now: _dt.datetime | None = None) -> str:
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return "b" + now.strftime("%Y%m%dT%H%M%S%f")


# --------------------------------------------------------------------- sources
@dataclass
class DiskSource:
    """Transcript folders on disk (or any Hadoop file system).

    ``code_only`` / ``cowork_only`` select one source (U3).
    """
    claude_dir: str | None = None
    cowork_dir: str | None = None
    code_only: bool = False
    cowork_only: bool = False
    derives_project_paths = True   # S5: paths come from dir names and sidecars

    def discover(self, spark: SparkSession) -> DataFrame:
        parts = []
        if self.claude_dir and not self.cowork_only:
            parts.append(T.discover_code_files(spark, self.claude_dir)
                         .withColumn("cowork_dir_id", F.lit(None).cast("string"))
                         .withColumn("sidecar_path", F.lit(None).cast("string")))
        if self.cowork_dir and not self.code_only:
            # listed once for transcripts and sidecars
            self._tree = T.list_cowork(spark, self.cowork_dir)
            parts.append(T.discover_cowork_files(spark, self.cowork_dir, self._tree))
        if not parts:
            return spark.createDataFrame([], _FILES_SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        self.found = out
        return out

    def lines(self, spark: SparkSession, chosen: DataFrame, whole: bool = False) -> DataFrame:
        """The lines of the chosen files; ``whole``: these are all that there are."""
        if whole and self.claude_dir and not self.cowork_only and not T.files.reachable(self.claude_dir):
            code = T.read_all_code_lines(spark, chosen.filter(F.col("source") == T.CODE), self.claude_dir)
            rest = chosen.filter(F.col("source") != T.CODE)
            return code.unionByName(self.lines(spark, rest)) if self.cowork_dir and not self.code_only else code
        return T.read_lines(spark, chosen, root=self.claude_dir or self.cowork_dir or "/")

    def sidecars(self, spark: SparkSession) -> DataFrame | None:
        if self.cowork_dir and not self.code_only:
            return T.read_sidecars(spark, self.cowork_dir, getattr(self, "_tree", None))
        return None


@dataclass
class LinesSource:
    """Already-rendered lines (the LINES contract), e.g. the synthesised corpus."""
    lines_df: DataFrame
    files_df: DataFrame | None = None   # FILE_COLS, one row for every file of the lines, when known

    def discover(self, spark: SparkSession) -> DataFrame:
        files = self.files_df
        if files is None:
            files = self.lines_df.groupBy(*schemas.FILE_COLS).agg(F.lit(1).alias("_n")).drop("_n")
        return (files.select(*schemas.FILE_COLS)
                .withColumn("cowork_dir_id", F.lit(None).cast("string"))
                .withColumn("sidecar_path", F.lit(None).cast("string")))

    def lines(self, spark: SparkSession, chosen: DataFrame, whole: bool = False) -> DataFrame:
        """The lines of the chosen files; ``whole``: these are all that there are, but for losers.

        Lines are shuffled only if many files are chosen and many are not."""
        mine = chosen.select("file_path")
        if whole and self.files_df is not None:
            rest = self.files_df.select("file_path").distinct().join(mine, "file_path", "left_anti")
            n = rest.count()
            if n <= FEW_REPLACED:
                lines = self.lines_df.filter("file_path IS NOT NULL")
                return lines.join(F.broadcast(rest), "file_path", "left_anti") if n else lines
        return self.lines_df.join(F.broadcast(mine) if mine.count() <= FEW_REPLACED else mine, "file_path", "left_semi")

    def sidecars(self, spark: SparkSession) -> DataFrame | None:
        return None


_FILES_SCHEMA = ("source string, file_path string, session_id string, is_agent boolean, "
                 "project_dir_name string, project_path string, file_size long, "
                 "file_mtime timestamp, load_rank int, cowork_dir_id string, sidecar_path string")


def _with_batch(table: str):
    from pyspark.sql import types as PT
    base = schemas.TABLES.get(table, PT.StructType([]))
    fields = [f for f in base.fields if f.name != "batch_id"]
    return PT.StructType(fields + [PT.StructField("batch_id", PT.StringType(), True)])


# --------------------------------------------------------------------- store
@dataclass
class TableRoot:
    spark: SparkSession
    root: str

    def current_generation(self) -> str | None:
        """The generation of the latest finished pointer; None for a new root.

        A root that has generations but no readable pointer is an error: a
        run must not start over beside data that it cannot see."""
        names = self._names(f"{self.root}/_current")
        done = sorted(n for n in names if n.startswith("gen-") and "_SUCCESS" in self._names(f"{self.root}/_current/{n}"))
        if done:
            return done[-1]
        if names or any(n.startswith("gen-") and self._names(f"{self.root}/{n}/etl_state") for n in self._names(self.root)):
            raise RuntimeError(f"{self.root} has generations, but none that {self.root}/_current points to")
        return None

    def _names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def set_generation(self, gen: str) -> None:
        (self.spark.createDataFrame([(gen,)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{self.root}/_current/{gen}"))

    def path(self, gen: str, table: str, batch: str | None = None) -> str:
        p = f"{self.root}/{gen}/{table}"
        return p if batch is None else f"{p}/batch_id={batch}"

    def read(self, gen: str, table: str) -> DataFrame:
        p = self.path(gen, table)
        try:
            return self.spark.read.option("basePath", p).parquet(p)
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc) or "does not exist" in str(exc):
                return self.spark.createDataFrame([], _with_batch(table))
            raise

    def state(self, gen: str | None) -> DataFrame:
        """Current manifest: the last row per file."""
        if gen is None:
            return self.spark.createDataFrame([], schemas.ETL_STATE)
        st = self.read(gen, "etl_state")
        cols = [f.name for f in schemas.ETL_STATE.fields if f.name != "file_path"]
        return (st.groupBy("file_path").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("s"))
                .select("file_path", "s.*"))

    def live_batches(self, gen: str) -> list[str]:
        """Batches in the manifest, oldest first, without those that a merge took over.

        A name for each run of the job. A merge counts once its own manifest is there."""
        done = {r[0] for r in self.read(gen, "etl_state").select("batch_id").distinct().collect()}
        merged = self.read(gen, "merged")
        if "input" in merged.columns:
            done -= {r["input"] for r in merged.collect() if r["batch_id"] in done}
        return sorted(done)

    def manifest(self, gen: str) -> DataFrame:
        """The manifest rows of the live batches that hold their session's rows."""
        return self.read(gen, "etl_state").filter(~F.col("is_loser") & F.col("batch_id").isin(self.live_batches(gen)))

    def project_paths(self, gen: str) -> DataFrame:
        """The path seen for each project folder, over all batches."""
        rows = self.read(gen, "project_dirs")
        if "_seen_cwd" not in rows.columns:
            return self.spark.createDataFrame([], "project_dir_name string, _seen_cwd string")
        return rows.groupBy("project_dir_name").agg(F.min("_seen_cwd").alias("_seen_cwd"))

    def views(self, gen: str | None = None) -> LazyTables:
        """The current view of all 8 tables (lazy)."""
        gen = gen or self.current_generation()
        if gen is None:
            raise FileNotFoundError(f"no table generation under {self.root}")

        memo: dict[str, DataFrame] = {}

        def winners():
            # One row per session: the batch holding its current rows, read
            # from the manifest each time (no cache: a cached plan over the
            # same folder would hide batches appended later).
            # Each batch that touches a session writes exactly one non-loser
            # manifest row for it, so the latest such batch is the session's
            # current one; no per-file reduction of the manifest is needed.
            if "w" not in memo:
                memo["w"] = self.manifest(gen).groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
            return memo["w"]

        def session_view(t):
            return lambda: current(self.read(gen, t))

        def current(rows: DataFrame) -> DataFrame:
            """Rows of the batches in the manifest, without the few (session,
            batch) pairs that a later batch replaced: the rows themselves stay
            where they are, and partitions of unfinished batches are pruned."""
            if "old" not in memo:
                memo["batches"] = self.live_batches(gen)
                st = self.read(gen, "etl_state").filter(~F.col("is_loser") & F.col("batch_id").isin(memo["batches"]))
                pairs = (st.groupBy("session_id").agg(F.max("batch_id").alias("latest"), F.collect_set("batch_id").alias("seen"))
                         .filter(F.size("seen") > 1)
                         .select("session_id", F.explode(F.array_remove("seen", F.col("latest"))).alias("batch_id")))
                n = pairs.count() if len(memo["batches"]) > 1 else 0
                memo["old"] = None if n == 0 else F.broadcast(pairs) if n <= FEW_REPLACED else pairs
            rows = rows.filter(F.col("batch_id").isin(memo["batches"]))
            if memo["old"] is not None:
                rows = rows.join(memo["old"], ["session_id", "batch_id"], "left_anti")
            return rows.drop("batch_id")

        def cowork_view():
            rows = self.read(gen, "cowork_sessions")
            cols = [f.name for f in schemas.COWORK_SESSIONS.fields if f.name != "cowork_session_id"]
            return (rows.groupBy("cowork_session_id")
                    .agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("v")).select("cowork_session_id", "v.*"))

        def tool_calls_view():
            rows = session_view("tool_calls")()
            if LOAD_ORDER not in rows.columns:
                return rows
            shared = self.read(gen, "shared_calls")
            if "tool_call_id" not in shared.columns:  # written before these were kept
                return first_call_wins(rows)
            ids = shared.select("tool_call_id").distinct()
            n = ids.count()
            ids = F.broadcast(ids) if n <= FEW_REPLACED else ids
            columns = [f.name for f in schemas.TOOL_CALLS.fields]
            if n == 0:
                return rows.select(*columns)
            alone = rows.join(ids, "tool_call_id", "left_anti").select(*columns)
            return alone.unionByName(first_call_wins(rows.join(ids, "tool_call_id", "left_semi")))

        def sessions_view():
            rows = session_view("sessions")()
            seen = self.project_paths(gen)
            return (rows.join(seen, "project_dir_name", "left")
                    .withColumn("project_path", F.when(F.col("source") == T.CODE, F.coalesce("_seen_cwd", "project_path")).otherwise(F.col("project_path")))
                    .select(*rows.columns))

        builders = {t: session_view(t) for t in SESSION_TABLES}
        builders["tool_calls"], builders["sessions"] = tool_calls_view, sessions_view
        self.stored = {"tool_calls": session_view("tool_calls")}
        builders["cowork_sessions"] = cowork_view
        builders["etl_state"] = lambda: self.state(gen)
        # D-1: skipped lines of the batches that hold current rows.
        builders["quarantine"] = lambda: (self.read(gen, "quarantine")
                                          .join(winners(), ["session_id", "batch_id"], "left_semi")
                                          .drop("batch_id"))
        return LazyTables(builders)


# --------------------------------------------------------------------- job
@dataclass
class RunResult:
    batch_id: str
    generation: str
    files_extracted: int
    summary: dict = field(default_factory=dict)


def shared_ids(store: TableRoot, gen: str) -> DataFrame:
    """The tool-call ids that batches so far have found in several sessions."""
    shared = store.read(gen, "shared_calls")
    if "tool_call_id" not in shared.columns:
        return store.spark.createDataFrame([], "tool_call_id string")
    return shared.select("tool_call_id").distinct()


def _shared_calls(store: TableRoot, gen: str, batch: str) -> DataFrame:
    """The tool-call ids of a batch that several sessions have, in it or in the batches before it.

    Narrow: ids and sessions only. Ids of sessions that were replaced since may be
    among them, which costs the view a few rows and changes none."""
    new = store.spark.read.parquet(store.path(gen, "tool_calls", batch)).select("tool_call_id", "session_id")
    here = (new.groupBy("tool_call_id").agg(F.min("session_id").alias("a"), F.max("session_id").alias("b"))
            .filter("a < b").select("tool_call_id"))
    before = store.read(gen, "tool_calls")
    if "tool_call_id" not in before.columns:
        return here
    before = before.filter(F.col("batch_id") != batch).select("tool_call_id", F.col("session_id").alias("other"))
    across = before.join(new, "tool_call_id").filter("other <> session_id").select("tool_call_id")
    return here.unionByName(across).distinct()


def _seen_paths(entries: DataFrame) -> DataFrame:
    """For each project folder the least ``cwd`` that its name encodes."""
    enc = F.regexp_replace("cwd", r"[/\\.]", "-")
    return (entries.filter(F.col("cwd").isNotNull() & (F.col("source") == T.CODE))
            .filter(enc == F.col("project_dir_name"))
            .groupBy("project_dir_name").agg(F.min("cwd").alias("_seen_cwd")))


def _resolve_project_paths(files: DataFrame, seen: DataFrame) -> DataFrame:
    """S5 (re-aimed): code dirs decode to an observed ``cwd`` whose encoding
    ('/', '\\' and '.' as '-') equals the dir name; else ``/a/b`` from ``-a-b``;
    a name without a leading '-' is kept. Cowork: ``cowork://title|id|unknown``."""
    fallback = F.when(F.col("project_dir_name").startswith("-"),
                      F.concat(F.lit("/"), F.replace(F.substring("project_dir_name", 2, 1 << 30), F.lit("-"), F.lit("/")))
                      ).otherwise(F.col("project_dir_name"))
    out = files.join(seen, "project_dir_name", "left")
    cowork_path = F.concat(F.lit("cowork://"), F.coalesce(F.nullif(F.col("_title"), F.lit("")),
                                                         F.col("cowork_dir_id"), F.lit("unknown")))
    return out.withColumn("project_path", F.coalesce(
        F.col("project_path"),
        F.when(F.col("source") == T.COWORK, cowork_path).otherwise(F.coalesce("_seen_cwd", fallback)))
    ).drop("_seen_cwd")


def run(spark: SparkSession, source, root: str, mode: str = "incremental",
        prices: dict | None = None, now: _dt.datetime | None = None,
        timings: dict | None = None, on_error: str = "line") -> RunResult:
    """Extract new and changed transcripts into the table root.

    ``mode='incremental'`` (I1): only files that are new or whose size or
    mtime changed are read, and they are re-read whole. ``mode='full'``
    (S10): every file, into a new generation that replaces the old one.

    ``on_error='line'`` (default) skips bad lines into the quarantine table;
    ``on_error='file'`` (D-2, the reference's behaviour) drops every file with
    a non-object JSON line from this batch and leaves it out of the manifest,
    so it is tried again next run.
    """
    if mode not in ("incremental", "full") or on_error not in ("line", "file"):
        raise ValueError(f"mode must be incremental|full and on_error line|file, got {mode!r}, {on_error!r}")
    apply_engine_conf(spark)
    with joins_by_seen_size(spark), shuffles_freed(spark):
        return _run(spark, source, root, mode, prices, now, timings, on_error)


def _run(spark: SparkSession, source, root: str, mode: str, prices: dict | None, now: _dt.datetime | None,
         timings: dict | None, on_error: str) -> RunResult:
    now = now or _dt.datetime.now(_dt.timezone.utc)
    batch = new_batch_id(now)
    clock = _Clock(timings)
    store = TableRoot(spark, root)
    gen = store.current_generation()
    if mode == "full" or gen is None:
        gen, prior = f"gen-{batch}", None
    else:
        prior = gen
    # A source may come in parts: each is in place until the next one is asked for,
    # and holds whole sessions, with the sidecars of their transcripts.
    parted = hasattr(source, "parts")
    chosen_path, bronze_path, side_path = (store.path(gen, t, batch) for t in ("_chosen", "bronze", "_sidecars"))
    n_files, n_parts = 0, 0
    for part in source.parts(spark) if parted else [source]:
        discovered = part.discover(spark)
        chosen = changed_files(discovered, store.state(prior)) if prior else discovered
        # One file per session in this batch; the later one in load order wins.
        win = F.max_by("file_path", F.struct("load_rank", "file_path")).over(Window.partitionBy("session_id"))
        chosen = chosen.filter("session_id IS NOT NULL").withColumn("is_loser", F.col("file_path") != win)
        # The chosen file set is written once, so every later step (and a retry
        # after a lost executor) sees the same listing, sizes and mtimes.
        own = f"{chosen_path}/part={n_parts}"
        chosen.write.mode("overwrite").parquet(own)
        chosen = spark.read.parquet(own)
        n, n_parts = chosen.count(), n_parts + 1
        clock("discover")
        if n == 0:
            continue
        # Parse once into bronze; everything else reads the bronze copy.
        lines = part.lines(spark, chosen.filter(~F.col("is_loser")), whole=prior is None)
        mode = "append" if n_files else "overwrite"
        parse_lines(lines).write.mode(mode).parquet(bronze_path)
        if parted:
            part.sidecars(spark).write.mode(mode).option("compression", "zstd").parquet(side_path)
        n_files += n
        clock("parse_bronze")
    if n_files == 0:
        return RunResult(batch, prior or gen, 0, {"sessions": 0})
    # of these parts alone: a run that was retried may have left others there
    chosen = spark.read.option("basePath", chosen_path).parquet(*[f"{chosen_path}/part={k}" for k in range(n_parts)])
    if n_parts > 1 and chosen.groupBy("session_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").count():
        raise ValueError("the files of a session are in several parts")
    chosen = chosen.drop("part")
    winners = chosen.filter(~F.col("is_loser"))
    entries = spark.read.parquet(bronze_path)
    if getattr(source, "derives_project_paths", False):
        # a file that went before it was read gets no session and no manifest row: it is no empty file
        gone = winners.filter("file_size > 0").select("file_path").join(entries.select("file_path").distinct(), "file_path", "left_anti")
        gone_path = store.path(gen, "_gone", batch)
        gone.write.mode("overwrite").parquet(gone_path)
        gone = spark.read.schema(gone.schema).parquet(gone_path)
        n_gone = gone.count()
        if n_gone:
            gone = F.broadcast(gone) if n_gone <= FEW_ROWS else gone
            winners = winners.join(gone, "file_path", "left_anti")
            chosen = chosen.join(gone, "file_path", "left_anti")
    clock("parse_bronze")
    quarantine_of(entries).write.mode("overwrite").parquet(store.path(gen, "quarantine", batch))
    if on_error == "file":
        failed = (entries.filter(F.col("parse_error") == "not_object")
                  .select("file_path").distinct())
        entries = entries.join(failed, "file_path", "left_anti")
        winners = winners.join(failed, "file_path", "left_anti")
        chosen = chosen.join(failed, "file_path", "left_anti")

    # Sidecar metadata (S3/J4): title feeds the cowork project path.
    side = spark.read.parquet(side_path) if parted else source.sidecars(spark)
    links = None
    files = winners
    if side is not None:
        links = winners.filter(F.col("sidecar_path").isNotNull()).join(side, "sidecar_path")
        meta = F.from_json("sidecar_text", "title string", schemas.ANY_LENGTH)
        titles = links.select("file_path", meta["title"].alias("_title"))
        files = files.join(titles, "file_path", "left")
    else:
        files = files.withColumn("_title", F.lit(None).cast("string"))
    if getattr(source, "derives_project_paths", False):
        _seen_paths(entries).write.mode("overwrite").parquet(store.path(gen, "project_dirs", batch))
        seen = store.project_paths(gen)
        files = _resolve_project_paths(files, F.broadcast(seen) if seen.count() <= FEW_ROWS else seen)
    files = files.drop("_title")
    ext = now.replace(tzinfo=None)
    tables = build_tables(entries, price_table(spark, prices), files=files.select(*schemas.FILE_COLS),
                          extracted_at=ext)
    # J5 stamps file references with the session start: read it back from the
    # sessions just written (one small scan) instead of re-aggregating bronze.
    tables._builders["files_referenced"] = lambda: build_files_referenced(
        entries, spark.read.parquet(store.path(gen, "sessions", batch)).select("session_id", "started_at"))
    # Rows sorted by session inside each file give Parquet min/max stats that
    # prune row groups for per-session reads; messages already arrive in that
    # order from their window, so no extra sort is planned for them.
    tables._builders["tool_calls"] = lambda: session_tool_calls(entries)
    sort_keys = {"messages": ["session_id"], "tool_calls": ["session_id"]}
    for t in SESSION_TABLES:
        df = tables[t]
        if t in sort_keys:
            df = df.sortWithinPartitions(*sort_keys[t])
        df.write.mode("overwrite").parquet(store.path(gen, t, batch))
        clock(t)
    _shared_calls(store, gen, batch).write.mode("overwrite").parquet(store.path(gen, "shared_calls", batch))
    if links is not None:
        build_cowork_sessions(links.select("cowork_dir_id", "session_id", "load_rank", "file_path",
                                           "sidecar_text")) \
            .write.mode("overwrite").parquet(store.path(gen, "cowork_sessions", batch))
    # The manifest last.
    manifest = chosen.select("file_path", "session_id", F.col("file_size").alias("file_size_bytes"),
                             F.col("file_mtime").alias("file_modified_at"),
                             F.lit(ext).cast("timestamp").alias("extracted_at"),
                             F.lit(batch).alias("batch_id"), "is_loser")
    manifest.drop("batch_id").write.mode("overwrite").parquet(store.path(gen, "etl_state", batch))
    if gen != prior:
        store.set_generation(gen)
    clock("manifest")
    out = RunResult(batch, gen, n_files, summary(spark, store, gen, batch))
    clock("summary")
    return out


class _Clock:
    """Optional wall-clock split of a run (seconds per step)."""

    def __init__(self, sink: dict | None):
        import time
        self._time = time.time
        self._sink = sink
        self._took = {}
        self._t = self._time()

    def __call__(self, step: str) -> None:
        if self._sink is not None:
            now = self._time()
            # a source in parts takes some steps several times
            self._took[step] = self._took.get(step, 0) + now - self._t
            self._sink[step] = round(self._took[step], 3)
            self._t = now


def summary(spark: SparkSession, store: TableRoot, gen: str, batch: str) -> dict:
    """What this batch extracted, in one job over the batch's partitions."""
    zero = F.lit(0).cast("long")

    def part(table, **cols):
        df = spark.read.parquet(store.path(gen, table, batch))
        base = {"sessions": zero, "messages": zero, "tool_calls": zero, "tool_uses": zero,
                "cost": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")}
        base.update(cols)
        return df.select(*[v.alias(k) for k, v in base.items()])

    one = F.lit(1).cast("long")
    u = (part("sessions", sessions=one, cost=F.col("estimated_total_cost_usd"),
              tool_uses=F.col("tool_call_count").cast("long"))
         .unionByName(part("messages", messages=one))
         .unionByName(part("tool_calls", tool_calls=one))
         .unionByName(part("quarantine", reason=F.col("reason"))))
    rows = u.groupBy("reason").agg(*[F.sum(c).alias(c) for c in
                                     ("sessions", "messages", "tool_calls", "tool_uses", "cost")],
                                   F.count(F.lit(1)).alias("n")).collect()
    tot = {k: sum((r[k] or 0) for r in rows if r["reason"] is None)
           for k in ("sessions", "messages", "tool_calls", "tool_uses", "cost")}
    bad = {r["reason"]: r["n"] for r in rows if r["reason"] is not None}
    return {"sessions": tot["sessions"], "messages": tot["messages"], "tool_calls": tot["tool_calls"],
            "cost_usd": tot["cost"], "skipped_lines": sum(bad.values()), "skipped_by_reason": bad,
            # D-3: tool uses not kept as rows (NULL id or name, or a repeated id)
            "tool_uses_dropped": int(tot["tool_uses"]) - int(tot["tool_calls"])}


def remove_old_generations(spark: SparkSession, root: str) -> list[str]:
    """Deletes the generations before the current one, and their pointers.

    Never called by a run: readers of an older generation, and a way back to
    it, end here. Generations after the current one (a full run that goes on)
    and all else under ``root`` stay. Returns the names removed.
    """
    store = TableRoot(spark, root)
    now = store.current_generation()
    if now is None:
        return []
    old = sorted(n for n in store._names(root) if n.startswith("gen-") and n < now)
    for folder in [f"{root}/_current/{n}" for n in old] + [f"{root}/{n}" for n in old]:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return old


def compact(spark: SparkSession, root: str, now: _dt.datetime | None = None) -> str:
    """Rewrite the current views as one batch of a new generation, then switch.

    Every incremental run adds one partition per table; compaction bounds the
    number of partitions and files that later reads must list. The manifest
    (with loser rows) is carried over, so the next incremental run sees the
    same state. Returns the new generation.
    """
    store = TableRoot(spark, root)
    gen = store.current_generation()
    if gen is None:
        raise FileNotFoundError(f"no table generation under {root}")
    batch = new_batch_id(now)
    new_gen = f"gen-{batch}"
    views = store.views(gen)
    views["tool_calls"] = store.stored["tool_calls"]()
    store.project_paths(gen).write.mode("overwrite").parquet(store.path(new_gen, "project_dirs", batch))
    for t in SESSION_TABLES + ["cowork_sessions", "quarantine"]:
        views[t].write.mode("overwrite").parquet(store.path(new_gen, t, batch))
    _shared_calls(store, new_gen, batch).write.mode("overwrite").parquet(store.path(new_gen, "shared_calls", batch))
    state = store.state(gen).drop("batch_id")
    state.write.mode("overwrite").parquet(store.path(new_gen, "etl_state", batch))
    store.set_generation(new_gen)
    return new_gen
