"""Tables written to the cluster's shared folder, to cut lineage or to be read more than once.

The folder is the session's ``spark.checkpoint.dir``.  It is set here only where
the session has none (local runs and tests); on a cluster every executor must be
able to reach it.  A table is a fresh folder below it, written by Spark's own
Parquet writer, so a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kmerspark-")
        spark.conf.set(KEY, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once, now, and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's tables, once no DataFrame that reads them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
