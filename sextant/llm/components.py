"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a minimum per node (pre-aggregated before its shuffle) and a join, so a node
with very many neighbours is never gathered in one task; edges end as stars around the
least node of each component. Each round starts from a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import drop, settle


def _star(edges: DataFrame) -> DataFrame:
    """One large-star round, then one small-star round, over distinct (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(down, "a")
    small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
    return small.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b; loops, repeats and either direction are fine.

    Returns (node, component) for every node that has an edge to another one: component is the
    least node that can be reached. No edges give no rows.
    """
    kept = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        after = settle(_star(kept), "edges")
        drop(kept)
        kept, last, mark = after, mark, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    leaves = kept.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
