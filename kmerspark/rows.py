"""An identity for rows of tables whose own ids may be null or repeated."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from kmerspark.scratch import materialize

#: Rows whose numbers are broadcast at most; a long each, in a hash table of longs.
MAX_BROADCAST = 2_000_000


def fresh(name: str, taken: Collection[str]) -> str:
    """name, or name with as many underscores in front as make it new among ``taken``, in either case of letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """df written once with a number for every row, and the number's column; what reads it again sees the same numbers."""
    row = fresh(name, df.columns)
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd"), row


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, by a shuffle, where its files alone would give fewer tasks; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def without_rows(df: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """df without those whose number is in rows(row).

    Up to MAX_BROADCAST numbers, by count, are broadcast, and df is not shuffled;
    beyond that the two meet by a shuffle on the number, with the same result.
    """
    few = rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return df.join(F.broadcast(rows) if few else rows, row, "left_anti")


#: A key with more rows than this, and more than a MOST_HOT-th of all rows, is hot; so there are at most MOST_HOT hot keys.
HOT, MOST_HOT = 1_000, 50_000


def meet(rows: DataFrame, table: DataFrame, keys: list[str], n: str, hot: int = HOT) -> DataFrame:
    """rows joined on the keys to table, which has each key once and in n how many rows have it.

    The hot keys of the table are broadcast, so their rows stay where they are;
    the others meet by a shuffle in which no key has many rows.  table is read
    three times: give a written one.
    """
    least = max(hot, (table.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    few = table.where(F.col(n) > least)
    own = rows.join(F.broadcast(few), keys)
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= least), keys)
    return own.unionByName(others)
