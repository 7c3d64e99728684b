"""Sequences of any length as blocks, and what is made of blocks put together again.

A block is a row of its own, with k characters of the one before.  What it has to
know of the rest of its sequence are two numbers, how many bases stand in one run
before and behind it.  What goes on from one block to the next is a part of the same
record, and records are numbered by how many begin in the blocks before, one row a
block.  Blocks are gone through twice: first for these numbers and for the parts at
a block's ends, which alone are shuffled, then for the records that lie inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from kmerspark.operators.flags import each_sequence
from kmerspark.operators.flat import Flat
from kmerspark.operators.windows import _CODE
from kmerspark.scratch import materialize

#: The columns of a block that Flat takes: characters of the block before, bases in one run before and behind, and whether it is the first.
EDGES = ["own", "before", "after", "opens"]
#: What a part of a record knows of its place: how many records of its block begin up to it, how many in all, whether it is the end of one from before, and where it starts in the block.
PLACED = StructType().add("nth", "long").add("begun", "long").add("goes_on", "boolean").add("inside", "long")
#: Characters that are cut at once.
CUT = 1 << 20
#: What is made of blocks: the parts' rows, starts, ends and whether they go on, and the columns of those that are picked.
Parts = Callable[[Flat], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[pa.Array]]]]


#: Blocks of a task on average, where there are more tasks than cores.
DEALT = 1 << 9


def _cut(text: str, k: int, size: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(block, own, before, after, text) of the blocks of a sequence."""
    chars = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    special = np.flatnonzero(_CODE[np.minimum(chars, 255)] > 3)
    begin = np.arange(0, max(1, len(text)), size)
    behind = np.minimum(begin + size, len(text))
    last, next_ = np.searchsorted(special, begin), np.searchsorted(special, behind)
    before = begin - np.concatenate(([0], special + 1))[last]
    after = np.append(special, len(text))[next_] - behind
    for i, (a, b, c) in enumerate(zip(begin.tolist(), before.tolist(), after.tolist(), strict=True)):
        yield i, min(k, a), b, c, text[max(0, a - k) : a + size]


def cut_blocks(seqs: DataFrame, kp1: int, size: int) -> tuple[list[str], DataFrame, DataFrame]:
    """The columns that seqs carries besides row, the blocks (row, block, EDGES, seq, carried), written, and these dealt to all tasks.

    row is that of seqs, or a number for each of its rows.
    """
    k = kp1 - 1
    if size < k:
        raise ValueError(f"blocks of {size} characters are shorter than {k}")
    carried = [c for c in seqs.columns if c not in ("seq", "row")]
    row = F.col("row").cast("long") if "row" in seqs.columns else F.monotonically_increasing_id()
    rows = seqs.select(row.alias("row"), "seq", F.struct(F.lit(True).alias("_"), *carried).alias("carried"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns[:5], pa.array([x[1] == 0 for x in held]), columns[5], b.column(2).take(pa.array(which))], ["row", "block", "own", "before", "after", "opens", "seq", "carried"])

        for b in batches:
            held, which, n = [], [], 0
            for i, (number, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                for block, *x in _cut(text.as_py() or "", k, size):
                    held.append((number, block, *x))
                    which.append(i)
                    n += len(x[-1])
                    if n >= CUT:
                        yield made()
                        held, which, n = [], [], 0
            if held:
                yield made()

    schema = StructType().add("row", "long").add("block", "long").add("own", "integer").add("before", "long").add("after", "long").add("opens", "boolean").add("seq", "string").add(rows.schema["carried"])
    blocks = materialize(rows.mapInArrow(cut, schema), "blocks", "zstd")
    tasks = max(seqs.sparkSession.sparkContext.defaultParallelism, blocks.count() // DEALT)
    return carried, blocks, blocks.repartition(tasks, "row", "block")  # a number, or short blocks would be put in few tasks


def _placed(flat: Flat, row: np.ndarray, start: np.ndarray, goes_on: np.ndarray) -> list[np.ndarray]:
    """The columns of PLACED for parts in the order of their rows."""
    begun = np.cumsum(~goes_on)
    first = np.searchsorted(row, row)
    last = np.searchsorted(row, row, "right") - 1
    before = begun[first] - ~goes_on[first]
    return [begun - before, begun[last] - before, goes_on, start - flat.first[row]]


def in_blocks(seqs: DataFrame, branches: DataFrame, kp1: int, size: int, parts: Parts, added: StructType, *aggregates: Column, **kw) -> DataFrame:
    """(row, id, start, total, carried, added) of the records that the parts of the blocks of seqs make up; carried has the other columns of seqs as fields.

    aggregates make one record's added columns of those of its parts.  total: the
    records of the sequence.
    """
    _, _, blocks = cut_blocks(seqs, kp1, size)

    def make(inner: bool) -> Callable[[Flat], tuple[np.ndarray, list[pa.Array]]]:
        def run(flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
            row, start, end, goes_on, columns = parts(flat)
            place = _placed(flat, row, start, goes_on)
            at_end = goes_on | (end == flat.end[row])
            pick = np.flatnonzero(~at_end if inner else at_end)
            return row[pick], [*(pa.array(c[pick]) for c in place), *columns(pick)]

        return run

    schema = StructType([*PLACED.fields, *added.fields])
    ends = materialize(each_sequence(blocks, branches, kp1, make(False), schema, block=EDGES, **kw), "ends", "zstd")
    over = W.partitionBy("row")
    begun = ends.groupBy("row", "block").agg(F.max("begun").alias("n"))
    earlier = begun.select("row", "block", F.coalesce(F.sum("n").over(over.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("n").over(over).alias("total"))
    earlier = materialize(earlier, "earlier", "zstd").hint("merge")  # many rows in few bytes: none to be broadcast
    id_, start = (F.col("earlier") + F.col("nth") - 1).alias("id"), F.col("block") * size + F.col("inside")
    inside = each_sequence(blocks.join(earlier, ["row", "block"]), branches, kp1, make(True), schema, block=EDGES, **kw)
    whole = inside.select("row", id_, start.alias("start"), "total", "carried", *added.names)
    crossing = ends.join(earlier, ["row", "block"]).select("*", id_).groupBy("row", "id").agg(F.min(F.when(~F.col("goes_on"), start)).alias("start"), F.max("total").alias("total"), F.any_value("carried").alias("carried"), *aggregates)
    return whole.unionByName(crossing)
