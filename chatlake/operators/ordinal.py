"""Skew-safe positions within a group (W1 sequence numbers, S8 line numbers).

A plain ``row_number().over(partitionBy(key))`` sends a whole group to one
task; one session may hold a third of all lines. Here the order is cut
into *blocks* (a monotone, coarse function of the order key, e.g.
``line_num div 65536``). The position of a row is

    (rows of its group in earlier blocks) + (rank inside its block)

The first term comes from a per-(group, block) count (map-side combined,
one row per block) and a running sum over the blocks of a group, which
holds ``#blocks`` rows per group, not ``#rows``. The second term is a
window over (group, block), bounded by the block size. Group and block are
one struct column, in which nulls are values like others: the join back on it
reuses the window's hash partitioning, so the rows are shuffled once. Everything is deterministic; no nondeterministic ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BLOCK = 1 << 16


def dense_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   block: Column, out: str = "position") -> DataFrame:
    """Add ``out`` = 0-based position of each row in its ``keys`` group by ``order``.

    ``block`` must be non-decreasing in ``order`` within a group.
    """
    keys = list(keys)
    b = "__blk"
    k = "__key"
    with_blk = df.withColumn(b, block)
    counts = with_blk.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(prior), F.lit(0))).select(F.struct(*keys, b).alias(k), "__off")
    ranked = with_blk.withColumn(k, F.struct(*keys, b)).withColumn(
        "__rk", F.row_number().over(Window.partitionBy(k).orderBy(*order)) - 1)
    return (ranked.join(offsets, k)
            .withColumn(out, (F.col("__off") + F.col("__rk")).cast("long"))
            .drop(k, b, "__off", "__rk"))


def line_position(df: DataFrame, keys: Sequence[str], line_col: str = "line_num",
                  out: str = "position", block_size: int = LINE_BLOCK) -> DataFrame:
    """Position among the rows of a group ordered by a line number."""
    return dense_position(df, keys, [line_col],
                          F.floor(F.col(line_col) / F.lit(block_size)).cast("long"), out)
