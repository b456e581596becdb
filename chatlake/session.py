"""Spark session helpers.

Everything the engine needs from the session is read from it: the
checkpoint folder comes from ``spark.checkpoint.dir`` (the shared folder a
cluster names); a local default is only set when that setting is absent,
as in tests and local benchmarks.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. UTC matters: day buckets (R16, R17) and
# ISO timestamps without an offset are read in the session time zone.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many small transcript files: pack them into fewer scan tasks.
    "spark.sql.files.openCostInBytes": str(1 << 20),
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "chatlake", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


#: Bytes of shuffled rows that a task takes, as written: rows of JSON and text are some ten times that in memory.
TASK_BYTES = 16 << 20


def apply_engine_conf(spark: SparkSession) -> None:
    """Pin the runtime setting results depend on, UTC day buckets, and the one that bounds a task's rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))


#: Bytes of rows in memory up to which Spark may broadcast a side of a join by itself, once it has seen them.
BROADCAST_BYTES = 10 << 20


@contextlib.contextmanager
def joins_by_seen_size(spark: SparkSession):
    """Joins that are planned and run in here are broadcast by hint, or by the size that a shuffle has seen.

    Not by the size of files: paths and ids in compressed Parquet are some thirty times that in memory,
    so a file of a few MB can be a table that the driver has no room for."""
    with _set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES)}):
        yield


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """What a query that is built and run in here has shuffled leaves the executors' disks when it ends.

    Else it stays until the driver's heap happens to be collected, so the steps of a job add up there."""
    with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    """Runtime settings that hold in here."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, rows_each: int) -> DataFrame:
    """``df`` over tasks of about ``rows_each`` rows, however few row groups its files have."""
    tasks = min(-(-df.count() // rows_each), 10_000)
    return df.repartition(tasks) if tasks > 1 else df


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint folder); only
    when neither is set in a local run (tests) a folder under the system temp
    dir is created and registered, once. On a cluster no machine's own folder
    would do, so there the setting must be there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="chatlake-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # core settings may be read-only at runtime
            pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """This package on every executor, for functions that run in Python workers. Once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="chatlake-"), "chatlake-package.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
