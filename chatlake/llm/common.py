"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

import chatlake
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import scratch_path

#: Rows of text in one Arrow batch: a worker holds one batch at a time, and
#: single texts may be megabytes long.
BATCH_ROWS = 256

#: White space between words, as a character class of a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def python_workers(spark: SparkSession) -> None:
    """What Python workers need: this package on every executor, and Arrow
    batches of few whole texts, so that a worker holds little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(chatlake.__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="chatlake-"), "chatlake.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: a lost executor costs only what was not yet written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(id_col: str | Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 (a null id: not held out)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, those with the least seeded hash of ``keys``.

    Only for rows that a model is fitted on. ``df`` should be narrow: it is
    written once. A limit of an ordered table takes so many rows from every
    partition into one task, so hashes beyond about four times the rows asked
    for are left out before; if too few are under that bound (rows alike in
    ``keys`` share a hash), all are ordered.
    """
    df = saved(df, "sample")
    order = F.xxhash64(F.lit(20_24), *[F.col(k) for k in keys])
    n = df.count()
    if n > 8 * rows:
        under = df.where(order <= F.lit(-(1 << 63) + int((1 << 64) * 4 * rows / n)))
        df = under if under.count() >= rows else df
    return df.orderBy(order, *keys).limit(rows)
