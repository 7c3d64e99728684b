"""Alignments as SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Flags of secondary and supplementary alignments, and of the reverse strand.
NOT_PRIMARY, REVERSE = 0x900, 0x10


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, pos, seq) of the alignment lines."""
    cells = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"))
    return cells.select(F.get("c", 0).alias("qname"), F.get("c", 1).cast("int").alias("flag"), F.get("c", 2).alias("rname"), F.get("c", 3).cast("long").alias("pos"), F.get("c", 9).alias("seq"))


def primary(alignments: DataFrame) -> DataFrame:
    """The alignments that are neither secondary nor supplementary."""
    return alignments.where(F.col("flag").bitwiseAND(NOT_PRIMARY) == 0)


def totals(alignments: DataFrame) -> DataFrame:
    """One row: sequences, bases ("*" has none), and sequences on the reverse strand, among the primary."""
    return primary(alignments).agg(F.count(F.lit(1)).alias("seqs"), F.coalesce(F.sum(F.length(F.nullif("seq", F.lit("*")))), F.lit(0)).cast("long").alias("bases"), F.count_if(F.col("flag").bitwiseAND(REVERSE) != 0).alias("reverse"))


def sequences(alignments: DataFrame) -> DataFrame:
    """(name, seq) of the primary alignments, as they are written: what sources.fasta.write_fasta takes; "*" for no sequence, or an empty one, is left out."""
    return primary(alignments).where("seq NOT IN ('*', '')").select(F.col("qname").alias("name"), "seq")
