"""Statistics over k-mer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kmerspark.functions import codec
from kmerspark.operators.sets import adjacent_deltas


def delta_histogram(codes: DataFrame) -> DataFrame:
    """(x, y): how often neighbours in k-mer order differ by x."""
    return adjacent_deltas(codes).groupBy(F.col("delta").alias("x")).agg(F.count(F.lit(1)).alias("y"))


def tail_histogram(codes: DataFrame) -> DataFrame:
    """(x, y): the same by the number of last bases that the difference reaches; 1 for no difference."""
    tail = F.greatest(F.lit(1), F.length(F.conv(F.col("x").cast("string"), 10, 4))).cast("long")
    return delta_histogram(codes).groupBy(tail.alias("x")).agg(F.sum("y").alias("y"))


def delta_mean(codes: DataFrame) -> DataFrame:
    """One row: the first and the last code, and the mean gap."""
    return codes.agg(F.min("code").alias("first"), F.max("code").alias("last"), F.count(F.lit(1)).alias("n")).select("first", "last", "n", F.round((F.col("last") - F.col("first")) / F.when(F.col("n") > 1, F.col("n") - 1), 4).alias("mean_gap"))


def histogram_summary(hist: DataFrame) -> DataFrame:
    """One row about a histogram (x, y) of differences."""
    return hist.agg((F.sum("y") + 1).alias("kmers"), F.sum(F.col("x") * F.col("y")).alias("cumulative"), F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("types"), F.sum("y").alias("n")).select(
        "kmers", "cumulative", F.round(F.col("cumulative") / F.col("n"), 2).alias("mean"), "least", "most", "types"
    )


def histogram_json(hist: DataFrame, k: int, path: str, by_tail: bool) -> DataFrame:
    """One row with the histogram as JSON, x ascending."""
    pairs = hist.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("h"))
    return pairs.select(F.to_json(F.struct(F.lit(k).alias("k"), F.lit(path).alias("filepath"), F.lit(by_tail).alias("countBaseVar"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))).alias("json"))


def prefix_clusters(codes: DataFrame, k: int, lengths: Sequence[int] = (10, 9, 8, 7, 6)) -> DataFrame:
    """(l, prefix, size): rows for each prefix of l bases.

    Counted once at the longest length and rolled up from there; each level reads
    the one before, which has at most 4 ** l rows.
    """
    longest = max(lengths)
    if k < longest:
        raise ValueError(f"k must be at least {longest}")
    level = codes.groupBy(codec.prefix("code", k - longest).alias("p")).agg(F.count(F.lit(1)).alias("size"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("l"), codec.prefix("p", longest - n).alias("p")) for n in sorted(lengths, reverse=True)])).alias("x")
    rolled = level.select("size", each).groupBy("x.l", "x.p").agg(F.sum("size").alias("size"))
    names = F.lit(None).cast("string")
    for n in lengths:
        names = F.when(F.col("l") == n, codec.decode("p", n)).otherwise(names)
    return rolled.select("l", names.alias("prefix"), "size")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(l, size, n): how many prefixes have each size."""
    return clusters.groupBy("l", "size").agg(F.count(F.lit(1)).alias("n"))


def cluster_quantiles(clusters: DataFrame) -> DataFrame:
    """(l, q20, median, q80), exact, with linear interpolation."""
    q = lambda p: F.round(F.percentile("size", F.lit(p)), 4)
    return clusters.groupBy("l").agg(q(0.2).alias("q20"), q(0.5).alias("median"), q(0.8).alias("q80"))


def lengths(lines: DataFrame, column: str) -> DataFrame:
    """(length, n) of a column's strings."""
    return lines.groupBy(F.length(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def base_composition(seqs: DataFrame) -> DataFrame:
    """(code, n): bases by code, 4 for other characters and 5 for gaps, by the lengths that removing them takes off."""
    n = lambda pattern: F.sum(F.length("seq") - F.length(F.regexp_replace("seq", pattern, ""))).cast("long")
    one = seqs.agg(*[n(f"[{b}{b.lower()}]").alias(f"c{i}") for i, b in enumerate(codec.BASES)], n("[^ACGTacgt-]").alias("c4"), n("-").alias("c5"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("code"), F.coalesce(f"c{i}", F.lit(0)).alias("n")) for i in range(6)])).alias("x")).select("x.*")
