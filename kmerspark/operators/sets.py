"""K-mer tables as bags and sets: sort, merge, compare, check, view, search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from kmerspark.functions import codec
from kmerspark.ranks import ranked
from kmerspark.scratch import materialize


def sort_kmers(kmers: DataFrame, distinct: bool = False) -> DataFrame:
    """In k-mer order: a range shuffle and a sort in each range; rows of one k-mer may take several ranges."""
    if distinct:
        return kmers.distinct().orderBy(codec.unsigned_order("code"))
    return kmers.orderBy(codec.unsigned_order("code"), F.rand(1))


def merge(tables: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of the tables, or each k-mer once."""
    rows = reduce(DataFrame.unionByName, [t.select("code") for t in tables])
    return rows.distinct() if distinct else rows


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that are left when each of b's has taken one like it away."""
    if a.sameSemantics(b):
        return a.select("code").limit(0)
    return a.select("code").exceptAll(b.select("code"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").intersect(b.select("code"))


def compare_info(ref: DataFrame, tgt: DataFrame, k: int) -> DataFrame:
    """One row: k, the rows of either table, and the rows that either has over the other.

    Rows are counted by k-mer first, in partial aggregates, and the two counts
    of a k-mer meet once.
    """
    both = ref.select("code", F.lit(1).alias("r"), F.lit(0).alias("t")).unionByName(tgt.select("code", F.lit(0).alias("r"), F.lit(1).alias("t")))
    by = both.groupBy("code").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(total("r").alias("ref"), total("t").alias("tgt"), total(F.greatest(F.col("r") - F.col("t"), F.lit(0))).alias("rmt"), total(F.greatest(F.col("t") - F.col("r"), F.lit(0))).alias("tmr")).select(F.lit(k).alias("k"), "*")


def with_positions(kmers: DataFrame) -> DataFrame:
    """(pos, code) in k-mer order, as a sorted file has them."""
    return ranked(kmers.select("code"), [codec.unsigned_order("code")], "pos").select("pos", "code")


def _with_previous(table: DataFrame) -> DataFrame:
    """table(pos, code) with the code at the position before, without a window over the whole table.

    Positions are cut into blocks; a block's first row meets the last of the
    block before, of which there is one each.  Rows in order compress to next to
    nothing, so tasks are made by their number, not by the size of what is shuffled.
    """
    tasks = max(1, -(-table.count() // (BLOCK * TOGETHER)))
    blocked = table.withColumn("_block", F.floor(F.col("pos") / BLOCK)).repartition(tasks, "_block")
    inside = blocked.withColumn("_before", F.lag("code").over(W.partitionBy("_block").orderBy("pos")))
    ends = blocked.groupBy((F.col("_block") + 1).alias("_next")).agg(F.max_by("code", "pos").alias("_last"))
    joined = inside.join(ends, inside["_block"] == ends["_next"], "left")
    return joined.select("pos", "code", F.coalesce("_before", "_last").alias("before"))


#: Rows of a block, and blocks of a task on average.
BLOCK, TOGETHER = 1 << 16, 32


def check_order(table: DataFrame, strict: bool = False) -> DataFrame:
    """One row about table(pos, code): whether it is in order, and the position of the first row that is not."""
    now, before = codec.unsigned_order("code"), codec.unsigned_order("before")
    wrong = before >= now if strict else before > now
    return _with_previous(table).agg(F.min(F.when(wrong, F.col("pos"))).alias("first_violation"), F.count(F.lit(1)).alias("n")).select("n", F.col("first_violation").isNull().alias("sorted"), "first_violation")


def adjacent_deltas(codes: DataFrame) -> DataFrame:
    """(delta): the differences of codes next to each other in order; for k of 31 or less.

    One range shuffle, which runs when this is called: differences inside a range
    by a window over the range, between ranges from one row each.
    """
    ranged = materialize(codes.select("code").repartitionByRange("code", F.rand(1)).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("delta", F.col("code") - F.lag("code").over(W.partitionBy("_range").orderBy("code"))).where("delta IS NOT NULL").select("delta")
    ends = ranged.groupBy("_range").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    between = ends.withColumn("delta", F.col("lo") - F.lag("hi").over(W.orderBy("lo", "hi"))).where("delta IS NOT NULL").select("delta")
    return inside.unionByName(between)


def view(table: DataFrame, n: int, tail: bool = False) -> DataFrame:
    """The first or the last n rows of table(pos, code); n is the feature."""
    return table.orderBy(F.col("pos").desc() if tail else F.col("pos").asc()).limit(n)


def search(table: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(code) with the position of the first such row in table(pos, code), or null."""
    first = table.groupBy("code").agg(F.min("pos").alias("pos"))
    return probes.join(first, "code", "left")


def neighbours(kmers: DataFrame, kp1: int) -> DataFrame:
    """(kmer, side, base, code) of the k+1-mers before and after each k-mer of kmers(kmer)."""
    bases = F.explode(F.array(*map(F.lit, codec.BASES))).alias("base")
    before = kmers.select("kmer", F.lit("pred").alias("side"), bases).withColumn("edge", F.concat("base", "kmer"))
    after = kmers.select("kmer", F.lit("succ").alias("side"), bases).withColumn("edge", F.concat("kmer", "base"))
    return before.unionByName(after).select("kmer", "side", "base", codec.encode("edge").alias("code")).where(F.length("kmer") == kp1 - 1)


