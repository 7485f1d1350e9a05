"""Merkle manifest of a dataset: concatenated-level strings over aligned blocks.

Rows are hashed in place (only digests are moved), numbered within their group in key
order, and dealt to aligned blocks of ``FANOUT ** LEVELS`` consecutive nodes. A block
keeps each of its levels as one string of fixed-width hex digests: the parents of a
level are hashes of its substrings of ``FANOUT`` digests, and a node's sibling segments
are the substrings left and right of it in its run. The tops of blocks are the nodes of
the next round, and the tops of groups the leaves of one more tree, whose top is the
root. Proofs come down the same way: a block is handed the path from its top to the
root once, and its nodes put their own segments before it.

Numbering takes no window over a group: rows are range partitioned by group and key,
``monotonically_increasing_id`` counts them in each sorted partition, and only one row
per (partition, group) enters a running sum. So a group may hold any share of all rows;
a task holds one block at a time. Everything is SQL functions; the blocks of each round
are stored, and they are the manifest.

Edges: null and empty values are told apart in a leaf (``-`` and ``0:``); null keys come
first, a null group is a group; rows with equal keys are leaves of their own, ordered by
digest; a table without rows has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.tables import stored

FANOUT = 8
LEVELS = 3
WIDTH = 64

_RUN = FANOUT * WIDTH
_PART = 33  # bits of monotonically_increasing_id that count inside a partition


def sha(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def leaf_hash(*values: Column) -> Column:
    """Digest of a row: each value as its byte count, ``:`` and itself, or ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return sha(F.concat(*parts))


@dataclass
class Tree:
    """Stored blocks of each round, leaves first, and the root of each group."""

    rounds: list[DataFrame]
    roots: DataFrame


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, ord, hash, load) with their place in their group and its size.

    ``leaves`` should be stored: range partitioning reads it twice.
    """
    keys = ["grp", "ord", "hash", "tie"]
    ranged = stored(
        leaves.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("tie", "ord")
        .withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", _PART))
    runs = (
        ranged.groupBy("grp", "part")
        .agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
        .selectExpr(
            "grp AS run_grp", "part AS run_part", "sum(n) OVER (PARTITION BY grp) AS size",
            "sum(n) OVER (PARTITION BY grp ORDER BY part) - n - begin AS shift",
        )
    )
    met = ranged["grp"].eqNullSafe(runs["run_grp"]) & (ranged["part"] == runs["run_part"])
    return ranged.join(runs, met).select(
        "grp", "size", (F.col("at") + F.col("shift")).alias("pos"), "hash", "load"
    )


def _levels(size: Column) -> Column:
    """Hashing steps from ``size`` nodes to one: the digits of size - 1 in base ``FANOUT``."""
    digits = F.length(F.conv((size - 1).cast("string"), 10, FANOUT))
    return F.when(size < 2, 0).otherwise(digits)


def _parents(level: str) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / _RUN).cast("int"))
    run = lambda i: sha(F.substring(F.col(level), i * _RUN + 1, F.lit(_RUN)))
    return F.array_join(F.transform(runs, run), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """grp, size, left (levels to go), block, nodes, l0 .. and top, a row per aligned block."""
    out = (
        nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**LEVELS))
        .groupBy("grp", "size", "left", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "load"))).alias("nodes"))
        .withColumn("l0", F.array_join("nodes.hash", ""))
    )
    for k in range(1, LEVELS + 1):
        below = f"l{k - 1}"
        out = out.withColumn(f"l{k}", F.when(F.col("left") >= k, _parents(below)).otherwise(F.col(below)))
    return stored(out.withColumnRenamed(f"l{LEVELS}", "top"))


def build(leaves: DataFrame) -> Tree:
    """The trees of all groups of ``leaves`` (grp, ord, hash, load)."""
    nodes = placed(leaves).withColumn("left", _levels(F.col("size")))
    most = leaves.groupBy("grp").count().agg(F.max(_levels(F.col("count"))).alias("left")).first()["left"] or 0
    rounds: list[DataFrame] = []
    while True:
        blocks = _blocks(nodes)
        rounds.append(blocks)
        nodes = blocks.where(F.col("left") > LEVELS).select(
            "grp", "size", (F.col("left") - LEVELS).alias("left"), F.col("block").alias("pos"),
            F.col("top").alias("hash"), F.lit(None).cast("int").alias("load"),
        )
        if len(rounds) * LEVELS >= most:
            break
    tops = [r.where(F.col("left") <= LEVELS).select("grp", "size", F.col("top").alias("root")) for r in rounds]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return Tree(rounds, roots)


def _segments(i: Column) -> Column:
    """Siblings left and right of node ``i`` of a block, level by level."""
    out = []
    for k in range(LEVELS):
        at = F.floor(i / FANOUT**k).cast("int")
        begin = F.floor(i / FANOUT ** (k + 1)).cast("int") * FANOUT
        level = F.col(f"l{k}")
        out.append(
            F.struct(
                F.substring(level, begin * WIDTH + 1, (at - begin) * WIDTH).alias("l"),
                F.substring(level, (at + 1) * WIDTH + 1, (begin + FANOUT - 1 - at) * WIDTH).alias("r"),
            )
        )
    return F.slice(F.array(*out), F.lit(1), F.least(F.col("left"), F.lit(LEVELS)))


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """grp, hash, load, path (array of l, r up to the root) of every leaf.

    ``above`` (grp, path, and further columns, a row per group) continues the paths
    beyond the groups' roots; its further columns come along.
    """
    if above is None:
        above = tree.roots.select("grp", F.expr("array()").cast("array<struct<l: string, r: string>>").alias("path"))
    more = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumnsRenamed({"grp": "above_grp", "path": "above_path"})
    down = None
    for k in reversed(range(len(tree.rounds))):
        blocks = tree.rounds[k]
        last = blocks.where(F.col("left") <= LEVELS)
        known = last.join(above, last["grp"].eqNullSafe(above["above_grp"])).drop("above_grp")
        if down is not None:
            up = down.select(
                F.col("grp").alias("above_grp"), F.col("pos").alias("above_pos"), F.col("path").alias("above_path"), *more
            )
            inner = blocks.where(F.col("left") > LEVELS)
            met = inner["grp"].eqNullSafe(up["above_grp"]) & (inner["block"] == up["above_pos"])
            known = known.unionByName(inner.join(up, met).drop("above_grp", "above_pos"))
        node = lambda x, i: F.struct(
            x["pos"].alias("pos"), x["hash"].alias("hash"), x["load"].alias("load"), F.concat(_segments(i), F.col("above_path")).alias("path")
        )
        down = known.select("grp", *more, F.inline(F.transform("nodes", node)))
    return down.drop("pos")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its sibling segments."""
    return F.aggregate(path, leaf, lambda h, s: sha(F.concat(s["l"], h, s["r"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, load: Column) -> DataFrame:
    """load, leaf, path, subroot and root of every row.

    ``columns`` are hashed, ``group`` splits the rows into trees ordered by ``key``,
    whose roots, ordered by group, are the leaves of the last tree. ``load`` is carried
    along.
    """
    leaves = docs.select(
        F.col(group).alias("grp"), F.struct(F.col(key).alias("key")).alias("ord"),
        leaf_hash(*(F.col(c) for c in columns)).alias("hash"), load.alias("load"),
    )
    trees = build(stored(leaves))
    tops = trees.roots.select(
        F.lit(0).alias("grp"), F.struct("grp").alias("ord"), F.col("root").alias("hash"),
        F.struct("grp", "root").alias("load"),
    )
    last = build(stored(tops))
    whole = last.roots.select(F.col("grp").alias("all"), F.col("root").alias("whole"))
    parts = proofs(last)
    above = parts.join(whole, parts["grp"] == whole["all"]).select(
        F.col("load.grp").alias("grp"), "path", F.col("load.root").alias("subroot"), F.col("whole").alias("root")
    )
    return proofs(trees, above).select("load", F.col("hash").alias("leaf"), "path", "subroot", "root")
