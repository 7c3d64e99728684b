"""One query per operator, over whole tables; ORACLE_SQL has those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerspark.llm import chat, chunks, collocations, decontaminate, language_id, odd_sketch, toxicity, variants, warc
from kmerspark.llm.mixing import mix_sources
from kmerspark.llm.quality_rules import quality_rules
from kmerspark.llm.sharding import shard_documents
from kmerspark.llm.simhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share; documents that share none do not appear."""
    return chunks.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.round_trip(_table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(_table(spark, sf_dir, "pages"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_chunks": op5_chunks,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_collocations": op12_collocations,
    "op13_odd_sketch": op13_odd_sketch,
}

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": decontaminate.ORACLE, "op6_chat": chat.ORACLE, "op10_warc": warc.ORACLE, "op11_variants": variants.ORACLE, "op12_collocations": collocations.ORACLE, "op13_odd_sketch": odd_sketch.ORACLE}
