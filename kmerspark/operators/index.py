"""A sorted k-mer file as a persistent index: ranges of codes in files of their own, and a manifest of their bounds.

A probe is looked up in the one file that can hold its first row, so a search
reads the files that its probes fall into and no others; within them Parquet's own
statistics and Spark's join do the rest.

Defined results: of equal codes the first position is found, also where a code
fills several files; probes that are null or lie outside all bounds have no
position; an empty table makes an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerspark.functions import codec
from kmerspark.operators import sets

#: K-mers of a file on average, and files of an index at most: their bounds are read by the driver, 16 bytes each.
ROWS, MAX_FILES = 1 << 22, 1_000_000


def write_index(table: DataFrame, path: str, rows: int = ROWS) -> None:
    """The index of table(code) at path: its rows in order, with their positions, and the manifest."""
    spark = table.sparkSession
    placed = sets.with_positions(table.select("code")).withColumn("key", codec.unsigned_order("code"))
    files = min(MAX_FILES, max(1, -(-placed.count() // rows)))
    placed.repartitionByRange(files, "key", "pos").sortWithinPartitions("key", "pos").write.parquet(f"{path}/ranges")
    ranges = spark.read.schema("pos long, code long, key long").parquet(f"{path}/ranges")
    bounds = ranges.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    bounds.coalesce(1).write.parquet(f"{path}/manifest")


def search_index(spark: SparkSession, path: str, probes: DataFrame) -> DataFrame:
    """probes(code, ...) with the position of the first such row of the index at path, or null; only files that can hold one are read."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if manifest.limit(MAX_FILES + 1).count() > MAX_FILES:
        raise ValueError(f"over {MAX_FILES} files in {path}")
    # a code that fills several files begins in the one of the least position
    bounds = manifest.orderBy("most", "first").toArrow()
    most, least = bounds.column("most").to_numpy(), bounds.column("least").to_numpy()
    shared = spark.sparkContext.broadcast((most, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, least = shared.value
        for b in batches:
            key = b.column(0).to_numpy()
            at = np.searchsorted(most, key)
            inside = (at < len(most)) & (least[np.minimum(at, len(least) - 1)] <= key) if len(most) else np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at[inside]))], ["at"])

    asked = probes.select(codec.unsigned_order("code").alias("key")).where("key IS NOT NULL")
    hit = sorted(r.at for r in asked.mapInArrow(run, "at long").distinct().collect())  # a row a file at most
    files = [bounds.column("file")[i].as_py() for i in hit]
    found = spark.read.schema("pos long, code long, key long").parquet(*files) if files else spark.createDataFrame([], "pos long, code long, key long")
    return probes.join(found.groupBy("code").agg(F.min("pos").alias("pos")), "code", "left")
