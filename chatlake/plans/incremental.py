"""Which discovered files need (re-)extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(discovered: DataFrame, state: DataFrame) -> DataFrame:
    """Keep a discovered file when it has no state row, or its size or mtime changed.

    ``discovered``: ``file_path, file_size, file_mtime, …``; ``state``: the
    manifest ``file_path, file_size_bytes, file_modified_at``. Adds
    ``reason`` ∈ {new, size, mtime}. Both sides hold one row per file; the
    join is an equi-join on ``file_path`` that AQE turns into a broadcast
    when the manifest is small and keeps as a shuffle join when it is not.
    """
    s = state.select(F.col("file_path").alias("_s_path"), F.col("file_size_bytes").alias("_s_size"),
                     F.col("file_modified_at").alias("_s_mtime"))
    j = discovered.join(s, discovered["file_path"] == s["_s_path"], "left")
    reason = (F.when(F.col("_s_path").isNull(), F.lit("new"))
              .when(~F.col("_s_size").eqNullSafe(F.col("file_size")), F.lit("size"))
              .when(~F.col("_s_mtime").eqNullSafe(F.col("file_mtime")), F.lit("mtime")))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_s_path", "_s_size", "_s_mtime")
