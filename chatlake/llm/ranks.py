"""Positions of rows in the order of their group, whatever its size.

Rows are cut into ranges of about equal size by (group, order), sorted there
and written; a row's position is that of its range's first row of the group
plus its own distance from it. No window or task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import fresh, saved

#: Rows of a range, and ranges at most (larger tables have larger ranges).
RANGE_ROWS, MAX_RANGES = 20_000, 20_000
#: (Group, range) pairs up to which their first positions are broadcast.
FEW_RANGES = 200_000


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], position: str = "position", size: str = "size") -> DataFrame:
    """``rows`` with their 0-based position by ``order`` in their ``group`` and that group's size.

    Rows alike in both are in any order, and dealt apart like others; nulls
    come first and null groups are groups. ``rows`` should be narrow: they are
    written twice. An empty table gives no row. Columns named ``position`` or
    ``size`` must not be there.
    """
    group, order = list(group), list(order)
    tie, at, part, first, n = fresh(rows, "tie", "at", "part", "first", "n")
    rows = saved(rows, "unranked")
    ranges = min(MAX_RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    by = [*group, *order, tie]
    dealt = (rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *by)
             .sortWithinPartitions(*by).drop(tie).withColumn(at, F.monotonically_increasing_id()))
    # the upper bits of the id name the range, the lower ones count its rows
    dealt = saved(dealt, "ranked").withColumn(part, F.shiftright(at, 33))
    heads = dealt.groupBy(*group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*group, part, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(first),
                         F.sum(n).over(whole).alias(size))
    heads = saved(heads.withColumnsRenamed({c: f"{c} of head" for c in [*group, part]}), "heads")
    if heads.count() <= FEW_RANGES:
        heads = F.broadcast(heads)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of head`")) for c in [*group, part]]
    return (dealt.join(heads, same).withColumn(position, F.col(first) + F.col(at))
            .select(*rows.columns, position, size))
