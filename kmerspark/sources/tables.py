"""Sequences from text columns.

Letters stand for bases in turn, blanks and line ends count on, and everything
else is special.  A whole text is one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kmerspark.rows import spread

LETTERS = "abcdefghijklmnopqrstuvwxyz \n#"
AS_BASES = ("ACGT" * 7) + "N"
#: Special characters that are replaced as letters are; a pattern costs far more for each that it finds.
_SPECIAL = "".join(chr(c) for c in range(1, 128) if chr(c) not in LETTERS and not chr(c).isupper())


def to_bases(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), LETTERS + _SPECIAL, AS_BASES + "N" * len(_SPECIAL))
    return F.regexp_replace(plain, "[^ACGTN]", "N")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq, lang, source) of the documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    text = F.replace(F.col("text"), F.lit("\u0130"), F.lit("i"))  # one letter in the SQL, two characters to Spark's lower()
    return docs.select(F.col("doc_id").alias("seq_id"), to_bases(text).alias("seq"), "lang", "source")


def turn_id(conv_id: Column, turn: Column) -> Column:
    """One long for a turn of a conversation, different for any two of them.

    Up to turn 999 it is conv_id * 1000 + turn; later turns lie below zero, where
    no such number is.  Ids that do not fit raise; it is null where either is.
    """
    early = (turn < 1000) & (conv_id < 1 << 53)
    fits = (turn >= 0) & (conv_id >= 0) & (early | ((turn >= 1000) & (turn < 1 << 31) & (conv_id < 1 << 32)))
    wide = -1 - (conv_id.cast("long") * (1 << 31) + turn)
    return F.when(~fits, F.raise_error(F.concat(F.lit("no sequence id for turn "), turn.cast("string"), F.lit(" of conversation "), conv_id.cast("string"))).cast("long")).when(early, conv_id * 1000 + turn).otherwise(wide)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq, role) of the turns of conversations."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(turn_id(F.col("conv_id"), F.col("turn")).alias("seq_id"), to_bases(F.col("text")).alias("seq"), "role")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq) of the benchmark items."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("seq_id"), to_bases(F.col("text")).alias("seq"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq) of the pages' html: many special characters."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("seq_id"), to_bases(F.col("html")).alias("seq"))
