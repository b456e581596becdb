"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits: bit b is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles. Two fingerprints are linked if
at most ``radius`` bits differ; then one of their two 32-bit segments differs
in at most ``radius // 2``. The tables of the index have an entry for each
segment of each different fingerprint; a fingerprint looks up the Hamming
ball of that radius around each of its segments, and whole distances are
verified. A ball holds only values reached by setting bits, as the other
fingerprint of a link reaches back by the rest: mixed changes cancel, so for
radius 1 each unordered pair of segment values is met once.

A table entry under which many fingerprints stand ("crowded") is not joined
with all of them: there the lookups go on to the ball of what is left of the
radius in the other segment, and meet exact fingerprints only. So no join
emits more than a fixed number of rows for each fingerprint. Lookups are
hundreds of times the file that they are made from, by whose size Spark would
broadcast them: the first join is sorted, the last may broadcast its other side.

Components are found by alternating large-star and small-star steps, each
written to the shared scratch folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import fresh, saved, python_workers

SEED = 42
BITS = 64
HALF = 32
#: Fingerprints under one table entry beyond which lookups meet exact fingerprints.
CROWDED = 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | bytes | None, words_each: int = 3) -> int:
    """The unsigned fingerprint; 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    w = raw.translate(_FOLD).split()
    if not w:
        return 0
    n = max(1, len(w) - words_each + 1)
    shingles = map(b" ".join, zip(*(w[i:i + n] for i in range(words_each)))) if len(w) >= words_each else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=n)
    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        part = h[i:i + _CHUNK]
        count += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str, words_each: int, *keep: str, out_col: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint as a signed long, a row for each row."""
    python_workers(docs.sparkSession)
    schema = docs.select(*keep).schema.add(out_col, "long")

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words_each) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, out_col])

    return docs.select(*keep, F.col(f"`{text_col}`").cast("binary").alias(fresh(docs, "text_bytes")[0])).mapInArrow(run, schema)


def _masks(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(HALF), d)]


def _flips(radius: int) -> list[tuple[int, int]]:
    return [(m, bin(m).count("1")) for m in _masks(radius)]


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * k).bitwiseAND(F.lit((1 << HALF) - 1))


def links(fps: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Pairs a < b of different fingerprints of the table ``fps`` (column fp,
    distinct) that differ in at most ``radius`` bits."""
    near = radius // 2
    if near > 1:
        raise ValueError("two segments serve radii up to 3")
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k).alias("key")) for k in (0, 1)])).alias("e")).select("fp", "e.k", "e.key")
    # looked up: the segment itself, and each value with one more bit set
    ball = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in _flips(near)])
    probes = (table.select("fp", "k", "key", F.explode(ball).alias("b"))
              .where("b.m & key = 0").select("fp", "k", F.expr("key | b.m").alias("key"), "b.d"))
    sizes = table.groupBy("k", "key").agg(F.count("*").alias("n"))
    # a lookup of its own value that finds itself alone leads nowhere
    met = saved(probes.hint("merge").join(sizes, ["k", "key"]).where("n > 1 OR d > 0"), "simhash-met")
    distance = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    plain = (met.where(F.col("n") <= crowded).join(table.withColumnRenamed("fp", "other"), ["k", "key"])
             .where((F.col("fp") != F.col("other")) & (distance(F.col("fp"), F.col("other")) <= radius)).select("fp", "other"))
    rest = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in _flips(radius)])
    exact = (met.where(F.col("n") > crowded).select("fp", "k", "key", F.col("d").alias("d0"), F.explode(rest).alias("b"))
             .where(F.col("d0") + F.col("b.d") <= radius)
             .select("fp", F.when(F.col("k") == 0, F.shiftleft(_segment(F.col("fp"), 1).bitwiseXOR(F.col("b.m")), HALF).bitwiseOR(F.col("key")))
                     .otherwise(F.shiftleft(F.col("key"), HALF).bitwiseOR(_segment(F.col("fp"), 0).bitwiseXOR(F.col("b.m")))).alias("other"))
             .where("fp != other").join(fps.select(F.col("fp").alias("other")), "other", "left_semi").select("fp", "other"))
    return plain.unionByName(exact).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``pairs`` (a, b): root is the least node reachable."""
    edges, before = saved(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "star"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 2,
                    keep: tuple[str, ...] = (), crowded: int = CROWDED) -> DataFrame:
    """A row for each row: its id, ``keep``, fp, root (least fingerprint of the
    component) and component_id (least id in the component; null if all are).

    Texts that are null, empty or without words have fingerprint 0 and are
    linked like any others; repeated rows each keep a row of their own.
    """
    rows = saved(fingerprints(docs, text_col, words_each, *dict.fromkeys((id_col, *keep))), "simhash-rows")
    fps = saved(rows.groupBy("fp").agg(F.min(F.col(id_col)).alias("least_id")), "simhash-fps")
    roots = components(links(fps.select("fp"), radius, crowded))
    member = saved(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id"), "simhash-members")
    named = saved(member.join(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp").select(id_col, *keep, "fp", "root", "component_id")
