"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrigenda.llm.common import cut


def _smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point neighbours at the smallest node around ``u``. Minima are pre-aggregated; the join back
    to the edges of a hot node is an equi-join that Spark may split."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    least = least.select(F.col("u").alias("k"), F.least("u", "low").alias("m"))
    pairs = edges.join(least, F.col("u") == F.col("k"))
    if larger_only:
        return pairs.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)`` (of any type with an order): the smallest node reachable.

    Self-loops and edges with a null end are ignored; repeated edges count once. Each round is
    written to the shared folder, so a lost executor costs one round at most. Rounds grow with the
    logarithm of the largest component; a graph still changing after ``max_rounds`` is an error.
    """
    e = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        mark = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both, True).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = cut(_smallest(down, False).where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
