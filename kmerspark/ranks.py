"""Numbering rows without pulling a group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kmerspark.scratch import materialize


def salt_of(*cols: Column | str, salts: int, seed: int = 42) -> Column:
    """A salt in [0, salts) that depends on the values alone, so reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(salts)).cast("int")


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank", salt: str = "_salt", facts: DataFrame | None = None) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order (salt, *order).

    df already has the int column ``salt``; group values are not null.  A group
    is numbered in as many pieces as it has salts: the sizes of the pieces are
    counted (partial sums, at most groups x salts rows), summed up in salt
    order, and added to the row number inside the piece.  No task sees more
    than one piece of a hot group.  ``facts``, keyed by the groups, are joined
    to the pieces and so reach the rows by the same join.
    """
    keys = [*groups, salt]
    before = W.partitionBy(*groups).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    pieces = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if facts is not None:
        pieces = pieces.join(facts, list(groups))
    rows = df.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    new = [c for c in (facts.columns if facts is not None else []) if c not in groups]
    return rows.join(pieces, keys).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).select(*df.columns, name, *new)


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank", keep: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Gapless numbers from 0 over the whole table in the given order; keep: the columns that are written, by default all; unique: no rows tie.

    The rows are range-partitioned and sorted once, written, and numbered by
    (rows in earlier ranges) + (place in the range): one shuffle, and a window
    over one row per range in place of one over the table.  Rows that tie may lie
    in several ranges and get numbers in no set order; add columns to ``order`` to
    fix it.  The shuffle runs when this is called.
    """
    keep = df.columns if keep is None else keep
    ranged = df.repartitionByRange(*order, *([] if unique else [F.rand(1)])).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_id"))
    kept = materialize(ranged, "ranked", "zstd").withColumn("_range", F.shiftright("_id", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(starts), "_range").withColumn(name, (place + F.col("_before")).cast("long")).select(*keep, name)
