"""Merkle manifest of a dataset: a digest for each row, group and the whole, with proofs.

Rows become leaves, ordered in their group. In a group every eight consecutive
nodes become one, and so on until one remains; the groups' last nodes make a
tree of the same kind. A leaf's rank in base eight names its way up: ranks are
cut into blocks of 512, and in a block the digit columns are grouped away one
after the other, each level nesting the structs of the level below. A block's
last transform walks its nested struct and emits what stands beside each
leaf on its way. Blocks are leaves of the next tier, whose proofs meet the
blocks by grouping, without a join; the rank alone takes a small one.
Blocks are dealt to tasks by their key, so a group may hold all rows.

Nulls: a null field has a mark of its own, a null group is a group and the first,
null order columns come first. Empty texts have zero bytes. Very long texts
are hashed where they are read; only digests move. Repeated rows are leaves
each, next to one another. Ties in the order go by the digest, so that the
root depends on the rows alone. An empty table gives no row. Names do not
clash: work columns are apart from those that are carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import saved
from chatlake.llm.ranks import ranked

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str | Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: str | Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, ``:`` and text; ``-`` if null."""
    def one(c):
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(*[one(c) for c in fields])


def fold(node: str | Column, path: str | Column) -> Column:
    """The root that ``node`` leads to by the siblings on its ``path``."""
    return F.aggregate(path, F.col(node) if isinstance(node, str) else node, lambda acc, s: digest(s["left"], acc, s["right"]))


def path_digest(path: str | Column) -> Column:
    """One digest of all siblings on a path, from the leaf's up."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _nodes(kids, start=None, length=None) -> Column:
    kids = kids if start is None else F.slice(kids, start, length)
    return F.array_join(F.transform(kids, lambda k: k["node"]), "")


def _merges(level: int) -> Column:
    """Whether a tree of ``size`` leaves has several nodes at this level."""
    return F.col("size") > FAN**level


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of 512 nodes (tree, position, size, node, kept), each one row with all below it nested."""
    digits = [F.col("position") % FAN, *[F.floor(F.col("position") / FAN**k) % FAN for k in range(1, LEVELS)]]
    rows = nodes.select("tree", "size", F.floor(F.col("position") / BLOCK).alias("block"),
                        *[d.cast("int").alias(f"d{k}") for k, d in enumerate(digits)], F.struct("node", "kept").alias("item"))
    # every grouping below has these two among its keys: one shuffle serves all
    rows = rows.repartition("tree", "block")
    for k in range(LEVELS):
        keys = ["tree", "block", "size", *[f"d{j}" for j in range(LEVELS - 1, k, -1)]]
        kids = F.sort_array(F.collect_list(F.struct(f"d{k}", "item.*")))
        node = F.when(_merges(k), F.sha2(_nodes(F.col("kids")).cast("binary"), 256)).otherwise(F.col("kids")[0]["node"])
        rows = rows.groupBy(*keys).agg(kids.alias("kids")).select(*keys, F.struct(node.alias("node"), "kids").alias("item"))
    return saved(rows.select("tree", "block", "size", "item.node", "item.kids"), "merkle-blocks")


def _beside(kids, i) -> Column:
    return F.struct(_nodes(kids, F.lit(1), i).alias("left"), _nodes(kids, i + 2, F.lit(FAN)).alias("right"))


def _opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """A row for each node in the blocks: tree, position, kept, node and its path to the root,
    ``above`` having (tree, position, path, tree_root, root) of each block."""
    none = {"kids": None, "size": None, "path": _PATH, "tree_root": "string", "root": "string"}
    both = (blocks.select("tree", "block", "size", "kids", *[F.lit(None).cast(none[c]).alias(c) for c in ("path", "tree_root", "root")])
            .unionByName(above.select("tree", F.col("position").alias("block"), F.lit(None).cast("long").alias("size"),
                                      F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "path", "tree_root", "root")))
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "kids", "path", "tree_root", "root")])

    def step(level, kids, i):
        return F.when(_merges(level), F.array(_beside(kids, i))).otherwise(F.array().cast(_PATH))

    leaves = F.flatten(F.flatten(F.transform("kids", lambda c, i: F.transform(c["kids"], lambda b, j: F.transform(
        b["kids"], lambda a, k: F.struct(
            (F.lit(FAN * FAN) * i + F.lit(FAN) * j + k).alias("place"), a["node"].alias("node"), a["kept"].alias("kept"),
            F.concat(step(0, b["kids"], k), step(1, c["kids"], j), step(2, F.col("kids"), i)).alias("path")))))))
    return (met.select("tree", "block", "path", "tree_root", "root", F.explode(leaves).alias("leaf"))
            .select("tree", (F.col("block") * BLOCK + F.col("leaf.place")).alias("position"), "leaf.kept", "leaf.node",
                    F.concat("leaf.path", "path").alias("path"), "tree_root", "root"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each tier, until every tree is a single node."""
    tiers = [_blocks(nodes)]
    while (tiers[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
        up = tiers[-1].select("tree", F.col("block").alias("position"), F.ceil(F.col("size") / BLOCK).alias("size"), "node",
                              F.lit(None).cast("boolean").alias("kept"))
        tiers.append(_blocks(up))
    return tiers


def manifest(rows: DataFrame, group: str, order: Sequence[str], node: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each row: the ``keep`` columns, its leaf digest ``node``, ``subroot`` (of its group), ``root``
    and ``path``, the digests left and right of it at each level up to the root.

    ``order`` and ``keep`` columns must have an order (no maps).
    """
    work = rows.select(F.col(group).alias("tree"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)], F.col(node).alias("node"),
                       F.struct(F.lit(True).alias("row"), *[F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)]).alias("kept"))
    placed = ranked(work, ["tree"], [*[f"by{k}" for k in range(len(order))], "node"])
    tiers = _tiers(placed.select("tree", "position", "size", "node", "kept"))
    subroots = tiers[-1].select(F.col("tree").alias("kept"), "node").select(F.struct("kept", "node").alias("kept"), "node")
    tops = _tiers(ranked(subroots.select(F.lit(0).alias("tree"), F.col("kept.kept").alias("name"), "node", "kept"), ["tree"], ["name"])
                  .select("tree", "position", "size", "node", "kept"))
    root = tops[-1].select("tree", F.col("block").alias("position"), F.array().cast(_PATH).alias("path"), "node")
    above = root.select("tree", "position", "path", F.lit("").alias("tree_root"), F.col("node").alias("root"))
    above = reduce(lambda up, blocks: _opened(blocks, up), reversed(tops), above)
    # a group's last node stands in one block of its last tier
    above = above.select(F.col("kept.kept").alias("tree"), F.lit(0).cast("long").alias("position"), "path", F.col("kept.node").alias("tree_root"), "root")
    out = reduce(lambda up, blocks: _opened(blocks, up), reversed(tiers), above)
    return out.select(*[F.col("kept")[f"keep{k}"].alias(c) for k, c in enumerate(keep)], F.col("node").alias(node),
                      F.col("tree_root").alias("subroot"), "root", "path")
