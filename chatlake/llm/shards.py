"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of a size that fits into
memory, by a seeded hash of the id and the record's place in the input, so
that repeated rows are dealt apart too. Pass two shuffles each bucket
(Fisher-Yates, ``shuffle`` with a seed) and writes it. The buckets one after
the other are a uniform permutation; its records are dealt to the shards in
turn: shard sizes in rows differ by one at most (law ``rows``).

Everything is DataFrame operations. Null texts have size 1, null ids are
dealt like others, and an empty table gives no rows. Equal texts have no
bearing on where records go. A very long text makes its own bucket as much
larger; ties of the seeded hash keep whole records, ordered by their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import fresh, saved

SEED = 17
#: Bytes of text that a bucket holds on average. A task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20
#: Tasks that buckets are dealt to, at most (bucket modulo tasks, so that all have as many, or one less).
MOST_TASKS = 100_000
#: Buckets up to which the table of their first places (16 bytes each) is broadcast.
FEW_BUCKETS = 2_000_000


def external_shuffle(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                     seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs``, and shard and slot (or names with underscores
    before them, if ``docs`` has these), from the written second pass."""
    shard, slot = fresh(docs, "shard", "slot")
    bucket, place, row, start = fresh(docs, "bucket0", "place0", "row0", "start0")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)) + F.lit(64))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))

    order = F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id())
    dealt = docs.select(F.struct(order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).alias(row))
    # pass one: the high bits of the hash choose a bucket; the whole hash orders it before it is shuffled
    dealt = dealt.withColumn(bucket, F.pmod(F.shiftright(F.col(f"{row}.o"), 8), F.lit(buckets)).cast("int"))
    # each bucket has a task of its own, or, beyond MOST_TASKS, each task buckets of its own
    dealt = dealt.repartitionById(min(buckets, MOST_TASKS), bucket)
    # pass two; sorted by bucket in each task, so that a task that runs again draws the same numbers
    whole = dealt.groupBy(bucket).agg(F.array_sort(F.collect_list(row)).alias(row)).sortWithinPartitions(bucket)
    mixed = whole.select(bucket, F.posexplode(F.shuffle(F.transform(row, lambda x: x["r"]), seed)).alias(place, row))
    written = saved(mixed, "shard-buckets")

    sizes = written.groupBy(bucket).agg(F.count("*").alias(start))
    before = sizes.select(bucket, (F.sum(start).over(_running(bucket)) - F.col(start)).alias(start))
    before = F.broadcast(before) if buckets <= FEW_BUCKETS else before
    at = F.col(start) + F.col(place)
    return written.join(before, bucket).select(f"{row}.*", (at % shards).cast("int").alias(shard), F.floor(at / shards).cast("long").alias(slot))


def _running(bucket: str):
    """Over one row for each bucket."""
    from pyspark.sql import Window

    return Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """The shuffled records as Parquet under ``path``, a folder for each shard."""
    out = external_shuffle(docs, shards, **options)
    out.write.partitionBy(fresh(docs, "shard")[0]).parquet(path)
