"""Counting k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerspark.functions import codec
from kmerspark.operators.windows import kmer_counts


def count_kmers(seqs: DataFrame, k: int, canonical: bool = False, least: int = 1, most: int | None = None, counter_max: int | None = None, spread: bool = False) -> DataFrame:
    """(code, cnt) of the distinct k-mers.

    Windows are counted where they are made, in arrays, and once more after one
    shuffle on the code; only a code and a number leave a batch.  Canonical counts fold the two strands after the first count, when
    only distinct k-mers are left to turn around.
    """
    counts = kmer_counts(seqs, k, spread=spread).groupBy("code").agg(F.sum("n").alias("cnt"))
    if canonical:
        folded = counts.select(codec.encode(codec.canonical(codec.decode("code", k))).alias("code"), "cnt")
        counts = folded.groupBy("code").agg(F.sum("cnt").alias("cnt"))
    if least > 1:
        counts = counts.where(F.col("cnt") >= least)
    if most is not None:
        counts = counts.where(F.col("cnt") <= most)
    if counter_max is not None:
        counts = counts.withColumn("cnt", F.least("cnt", F.lit(counter_max).cast("long")))
    return counts


def with_kmers(codes: DataFrame, k: int) -> DataFrame:
    """The column code replaced by kmer."""
    return codes.select(codec.decode("code", k).alias("kmer"), *[c for c in codes.columns if c != "code"])


def count_totals(seqs: DataFrame, k: int, least: int = 1, most: int = 10**9) -> DataFrame:
    """One row: sequences, windows, distinct k-mers, and how many of these are below and above the cut-offs."""
    counts = count_kmers(seqs, k)  # seqs is read twice, for the windows and for its rows
    one = counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"),
        F.count(F.lit(1)).alias("distinct_kmers"),
        F.count_if(F.col("cnt") < least).alias("below"),
        F.count_if(F.col("cnt") > most).alias("above"),
    )
    return one.select("*", seqs.agg(F.count(F.lit(1))).scalar().alias("sequences"))


def database_info(counts: DataFrame, k: int, both_strands: bool) -> DataFrame:
    """One row about a table of counts."""
    return counts.agg(F.count(F.lit(1)).alias("kmers"), F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total")).select(
        F.lit(k).alias("k"), F.lit(both_strands).alias("both_strands"), "kmers", "min_count", "max_count", "total"
    )
