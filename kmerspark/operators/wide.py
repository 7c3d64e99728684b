"""The positional transform of any number of rows: ranks of reversed prefixes, by one sort where they are short, else by prefix doubling.

Column j lists its characters in the order of the rows by columns j - 1 down to 0,
then by row.  A cell comes with the up to ``first`` characters before it, last one
first.  Where that is all that may come before, cells are sorted by it in one range
shuffle.  Else its rank among those of its column is a number that reaches that far,
and in a round a cell is ranked by its own rank and by that of the cell as far
before it as ranks reach, so they reach twice as far.  Only distinct pairs are
sorted, over all columns together, and no task holds a column.  A column has as
many cells as there are rows, which says where it begins among all cells.

Cells are small on disk and many in memory, so no join of theirs may be a broadcast.

Defined results: row tells rows apart; all strings have ``width`` characters, or it
raises; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerspark.ranks import ranked
from kmerspark.scratch import materialize

#: Characters before a cell that are sorted as they are.
FIRST = 64


def _cells(rows: DataFrame, width: int, first: int) -> DataFrame:
    """(row, col, value, before): before has the last of the characters first."""
    odd = F.raise_error(F.concat(F.lit(f"not {width} characters: row "), F.col("row").cast("string"))).cast("string")
    whole = F.when(F.length("s") == width, F.col("s")).otherwise(odd)
    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{first}}}"), F.lit(0))
    stretch = rows.select("row", F.posexplode(F.arrays_zip(cut.alias("own"), F.concat(F.array(F.lit("")), cut).alias("past"))).alias("nth", "x")).where("x.own IS NOT NULL")
    stretch = stretch.select("row", (F.col("nth") * first).alias("begin"), F.concat("x.past", "x.own").alias("text"), F.length("x.past").alias("past"), F.length("x.own").alias("own"))
    col = F.col("begin") + F.col("i")
    known = F.least(col, F.lit(first))
    each = stretch.select("row", "begin", "text", "past", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    return each.select("row", col.alias("col"), F.substring("text", F.col("past") + F.col("i") + 1, F.lit(1)).alias("value"), F.reverse(F.substring("text", F.col("past") + F.col("i") - known + 1, known)).alias("before"))


def pbwt_wide(rows: DataFrame, width: int, first: int = FIRST) -> DataFrame:
    """(col, rank, row, value) of rows(row, s) in one block; runs when this is called, in log2(width / first) rounds."""
    cells, reach = _cells(rows, width, first), first
    if reach >= width - 1:
        # one key whose first bytes tell most cells apart, as Spark sorts by these
        cells, order = cells.select("row", "col", "value", F.concat(F.lpad(F.col("col").cast("string"), len(str(width)), "0"), "before").alias("key")), ["key", "row"]
    else:
        cells = materialize(cells, "cells", "zstd")
        short = ranked(cells.groupBy("col", "before").agg(F.count(F.lit(1)).alias("n")), ["col", "before"], "r")
        now = cells.join(short.select("col", "before", "r").hint("merge"), ["col", "before"]).select("row", "col", "r")
        while reach < width - 1:
            now = materialize(now, "ranks", "zstd")
            far = now.select("row", (F.col("col") + reach).alias("col"), F.col("r").alias("q"))
            pairs = materialize(now.join(far.hint("merge"), ["row", "col"], "left").withColumn("q", F.coalesce("q", F.lit(-1))), "pairs", "zstd")
            higher = ranked(pairs.groupBy("col", "r", "q").agg(F.count(F.lit(1)).alias("n")), ["col", "r", "q"], "rank")
            now = pairs.join(higher.select("col", "r", "q", "rank").hint("merge"), ["col", "r", "q"]).select("row", "col", F.col("rank").alias("r"))
            reach *= 2
        cells, order = materialize(now, "ranks", "zstd").join(cells.select("row", "col", "value").hint("merge"), ["row", "col"]), ["col", "r", "row"]
    placed = ranked(cells, order, "place", keep=["col", "row", "value"], unique=True)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return placed.crossJoin(F.broadcast(n)).select("col", (F.col("place") - F.col("col") * F.col("_n")).alias("rank"), "row", "value")
