"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsieve.session import cut


def _least(edges: DataFrame, by: str, other: str, name: str) -> DataFrame:
    return edges.groupBy(by).agg(F.least(F.col(by), F.min(other)).alias(name))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, component): every node that has an edge, with the least node it is connected to.

    Nodes may be numbers or texts. Null ends and loops link nothing; repeated edges count once; an
    empty table gives no row. Each round links every node to the least node near it, so the number of
    rounds grows with the logarithm of the longest chain; the edges of a hot node are joined to its
    least neighbour (which combines before the shuffle), never collected. Rounds are cut by reliable
    checkpoints. The driver sees one checksum a round. Should ``max_rounds`` not be enough, which no chain
    that fits a table needs, it raises: an unfinished result is never returned.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = e.where(F.col("u") != F.col("v"))
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both, "u", "v", "m")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # u itself keeps its link to the least
        large = large.unionAll(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small-star: every smaller neighbour of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
