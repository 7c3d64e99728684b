"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerspark.scratch import materialize


def _toward(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each (u, v) becomes v -> the least neighbour of u; a hot u splits on the side of the edges."""
    return edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(u, v) of longs; root is the least node that it reaches.

    Each step replaces an edge by one toward the least neighbour of one of its
    ends, found by a partial aggregate.  The rows never outnumber the links by
    more than the nodes, and the count of rounds grows with the logarithm of the
    longest path.  Every round is written to the shared folder, so lineage stays
    short and a lost executor costs one round.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _toward(both.where("v > u"), least).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _toward(large, low).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
