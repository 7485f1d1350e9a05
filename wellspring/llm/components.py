"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it is linked with.

    In each round every node moves onto the neighbour (or itself) that comes first in an
    order drawn anew for the round; links are then rewritten, and those inside one node
    go. Both the links and the nodes they join shrink by a constant share, whatever the
    shape, so a chain takes as few rounds as a star. All steps are partial aggregates
    and joins on a node, which adaptive execution splits if it has very many links.
    """
    edges = stored(links.where("a != b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = stored(nodes.withColumn("root", F.col("node")))
    round_ = 0
    while not edges.isEmpty():
        round_ += 1
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = F.struct(F.xxhash64("b", F.lit(round_)).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64("a", F.lit(round_)).alias("h"), F.col("a").alias("to"))
        moves = stored(ends.groupBy("a").agg(F.min(place).alias("p")).select("a", F.least("p", own)["to"].alias("to")))
        first = edges.join(moves, "a").select(F.col("to").alias("c"), "b")
        second = first.join(moves.withColumnsRenamed({"a": "b"}), "b").select(F.col("c").alias("a"), F.col("to").alias("b"))
        moved = roots.join(moves.withColumnsRenamed({"a": "root"}), "root", "left")
        roots = stored(moved.select("node", F.coalesce("to", "root").alias("root")))
        edges = stored(second.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    return roots.join(least, "root").select("node", "label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links``: only links between different labels take part."""
    to = labels.withColumnRenamed("label", "to")
    at_a = links.join(to.withColumnRenamed("node", "a"), "a", "left").select("b", F.coalesce("to", "a").alias("c"))
    at_b = at_a.join(to.withColumnRenamed("node", "b"), "b", "left").select(F.col("c").alias("a"), F.coalesce("to", "b").alias("b"))
    grown = stored(components(at_b))
    kept = labels.join(grown.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    kept = kept.select("node", F.coalesce("new", "label").alias("label"))
    return stored(kept.unionByName(grown.join(labels, "node", "left_anti")))
