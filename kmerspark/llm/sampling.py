"""What the two classifiers share: the held-out fold, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    """True for the fold that nothing is learned from; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def sample_per_label(labelled: DataFrame, label: str, most: int, seed: int = 42) -> DataFrame:
    """(doc_id, label), each once, of at most ``most`` documents of each label, the first by a hash of doc_id.

    Labels are counted first, and only rows whose hash is low enough for twice
    as many as wanted go on to be ranked, so no task ranks a hot label whole;
    where most rows of a label repeat each other, the sample may be smaller.
    The counts are broadcast: a classifier has weights for each label in any case.
    """
    keyed = labelled.where("doc_id IS NOT NULL").select("doc_id", label, F.xxhash64(F.lit(seed), "doc_id").alias("_hash"))
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = F.shiftrightunsigned("_hash", 33) / float(1 << 31)
    low = keyed.join(F.broadcast(counts), label).where(share * F.col("_n") < 2 * most).select("doc_id", label, "_hash").distinct()
    first = W.partitionBy(label).orderBy(share, "_hash", "doc_id")
    return low.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= most).select("doc_id", label)


def texts_of(docs: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """picked, a bounded table with each key once, with a text of docs(*keys, text); of several texts that of the least hash."""
    found = docs.where("text IS NOT NULL").select(*keys, "text").join(F.broadcast(picked), keys)
    return found.groupBy(*picked.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
