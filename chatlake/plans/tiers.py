"""Tiered compaction. Neighbouring batches of like size become one batch.

``pipeline.compact`` rewrites all that a root holds. Here a batch has a tier, the
power of ``fanout`` its bytes have over ``base_bytes``, and a run of neighbours is
merged once it has ``fanout`` batches of one tier with none above it between
them. The result is in the next tier, so a row is rewritten once for each tier it
passes: the bytes rewritten follow the new data times the logarithm of the old.

A merged batch takes the name of its latest input with ``m`` behind it, so it
sorts after its inputs and before the batches that follow: whichever of them a view
sees, a session's latest batch holds its current rows. Its manifest is written last, and
from then on the ``merged`` table takes the inputs out of the views. Their files
stay for the readers that have them open until ``remove_merged`` is called.

One writer at a time, as for runs of the job. Rows that a later batch of the same
run of inputs replaced are left out; all others are copied as they are. Batches
without a manifest (a crash) are neither read nor removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import partials
from .pipeline import FEW_REPLACED, SESSION_TABLES, TableRoot

FANOUT = 8
BASE_BYTES = 16 << 20
_FOLDERS = SESSION_TABLES + ["cowork_sessions", "quarantine", "shared_calls", "project_dirs", "etl_state"]


def _path(spark: SparkSession, folder: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def batch_bytes(store: TableRoot, gen: str, batch: str) -> int:
    """Bytes of a batch's tables."""
    total = 0
    for t in _FOLDERS:
        where, fs = _path(store.spark, store.path(gen, t, batch))
        if fs.exists(where):
            total += fs.getContentSummary(where).getLength()
    return total


def tier_of(size: int, fanout: int, base_bytes: int) -> int:
    tier, top = 0, base_bytes
    while size >= top:
        tier, top = tier + 1, top * fanout
    return tier


def choose(sizes: list[tuple[str, int]], fanout: int = FANOUT, base_bytes: int = BASE_BYTES) -> list[str]:
    """The run of neighbours to merge next, lowest tier first; empty if there is none."""
    tiers = [(b, tier_of(n, fanout, base_bytes)) for b, n in sizes]
    for tier in sorted({t for _, t in tiers}):
        run: list[tuple[str, int]] = []
        for b, t in tiers + [("", tier + 1)]:
            if t <= tier:
                run.append((b, t))
            elif sum(x == tier for _, x in run) >= fanout:
                return [x for x, _ in run]
            else:
                run = []
    return []


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key."""
    cols = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("v")).select(*keys, "v.*")


def merge_batches(store: TableRoot, gen: str, inputs: list[str]) -> str:
    """Merges neighbouring live batches into one; returns its name."""
    spark, batch = store.spark, f"{inputs[-1]}m"
    if partials.is_kept(store, gen):
        partials.refresh(spark, store.root)  # while the rows to take back are still there

    def rows(table: str) -> DataFrame:
        return store.read(gen, table).filter(F.col("batch_id").isin(inputs))

    def write(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(store.path(gen, table, batch))

    pairs = rows("etl_state").filter(~F.col("is_loser")).groupBy("session_id").agg(
        F.max("batch_id").alias("last"), F.collect_set("batch_id").alias("seen")).filter(F.size("seen") > 1)
    old = pairs.select("session_id", F.explode(F.array_remove("seen", F.col("last"))).alias("batch_id"))
    if old.count() <= FEW_REPLACED:
        old = F.broadcast(old)
    for t in SESSION_TABLES + ["quarantine"]:
        write(rows(t).join(old, ["session_id", "batch_id"], "left_anti").drop("batch_id").sortWithinPartitions("session_id"), t)
    if store._names(store.path(gen, "cowork_sessions")):
        write(_latest(rows("cowork_sessions"), ["cowork_session_id"])
              .select(*[f.name for f in schemas.COWORK_SESSIONS.fields]), "cowork_sessions")
    if store._names(store.path(gen, "project_dirs")):
        write(rows("project_dirs").groupBy("project_dir_name").agg(F.min("_seen_cwd").alias("_seen_cwd")), "project_dirs")
    if store._names(store.path(gen, "shared_calls")):
        write(rows("shared_calls").select("tool_call_id").distinct(), "shared_calls")
    write(spark.createDataFrame([(b,) for b in inputs], "input string"), "merged")
    write(_latest(rows("etl_state"), ["file_path"]), "etl_state")
    return batch


def compact_tiers(spark: SparkSession, root: str, fanout: int = FANOUT, base_bytes: int = BASE_BYTES) -> list[tuple[str, list[str], int]]:
    """Merges until no run of neighbours is due. Returns (new batch, its inputs, bytes rewritten) for each merge."""
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    store = TableRoot(spark, root)
    gen = store.current_generation()
    if gen is None:
        raise FileNotFoundError(f"no table generation under {root}")
    done = []
    sizes = [(b, batch_bytes(store, gen, b)) for b in store.live_batches(gen)]
    while inputs := choose(sizes, fanout, base_bytes):
        batch = merge_batches(store, gen, inputs)
        n = batch_bytes(store, gen, batch)
        done.append((batch, inputs, n))
        at = [b for b, _ in sizes].index(inputs[0])
        sizes[at:at + len(inputs)] = [(batch, n)]
    return done


def remove_merged(spark: SparkSession, root: str) -> list[str]:
    """Deletes the files of batches that a merge took over. Never called by a run:
    readers that still have them open end here. Returns the names removed."""
    store = TableRoot(spark, root)
    gen = store.current_generation()
    if gen is None:
        return []
    live, merged = set(store.live_batches(gen)), store.read(gen, "merged")
    if "input" not in merged.columns:
        return []
    # an input can be a merge itself: its own folder of inputs stays, as their manifests go first
    gone = sorted({r["input"] for r in merged.collect()} - live)
    gone = [b for b in gone if any(store._names(store.path(gen, t, b)) for t in _FOLDERS + ["bronze", "_chosen"])]
    for t in ["etl_state", *[f for f in _FOLDERS if f != "etl_state"], "bronze", "_chosen"]:
        for b in gone:
            where, fs = _path(spark, store.path(gen, t, b))
            fs.delete(where, True)
    return gone
