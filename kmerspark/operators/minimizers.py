"""Signatures (minimizers) of k-mers, and the runs of k-mers that share one.

Sequences are cut into blocks that overlap by k - 1 bases, so a sequence of any
length is as many rows of work as it has blocks; what runs over a block's end is
put together again from one or two rows a block.

Defined results: a null seq counts as an empty one; rows that share a seq_id, or
have none, are sequences of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kmerspark.operators.windows import _CODE, BATCH, BLOCK, base_windows, blocks
from kmerspark.rows import numbered


def _check(k: int, m: int) -> None:
    if not 5 <= m <= 11 or m >= k:
        raise ValueError("m must be 5 to 11 and less than k")


@cache
def normal_mmers(m: int) -> np.ndarray:
    """The normalised value of every m-mer by its code: the lesser of it and its reverse complement among those allowed, else 4 ** m."""
    code = np.arange(4**m)
    digit = [(code >> 2 * (m - 1 - i)) & 3 for i in range(m)]
    a, c, g, t = (0, 1, 2, 3)
    refused = (digit[-3] == t) & (digit[-2] == t) | (digit[-3] == t) & (digit[-2] == g) & (digit[-1] == t)
    refused |= (digit[0] == a) & (digit[1] == c) & (digit[2] == a)
    for i in range(1, m - 1):
        refused |= (digit[i] == a) & (digit[i + 1] == a)
    other = sum((3 - digit[i]) << 2 * i for i in range(m))
    own = np.where(refused, 4**m, code)
    return np.minimum(own, own[other])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of values[i : i + n] for every i that has so many, by doubling."""
    width = 1
    while width < n:
        step = min(width, n - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def block_signatures(data: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signatures) of the windows of k bytes that hold bases only."""
    base = _CODE[data]
    places, _ = base_windows(base, k)
    if not len(places):
        return places, places
    at, code = base_windows(base, m)
    normal = np.full(len(base) - m + 1, 4**m, np.int64)
    normal[at] = normal_mmers(m)[code]
    return places, _least(normal, k - m + 1)[places]


def signatures(seqs: DataFrame, k: int, m: int = 9, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(seq_id, pos, signature) of every clean window of k bases: the least normalised m-mer in it."""
    _check(k, m)
    kind = seqs.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, which, n = [], [], 0
            for i, at in enumerate(b.column(1).to_pylist()):
                place, value = block_signatures(np.frombuffer(b.column(2)[i].as_buffer(), np.uint8), k, m)
                held.append((place + at, value))
                which.append(np.full(len(place), i))
                n += len(place)
                if n >= BATCH or i == b.num_rows - 1:
                    if n:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(which))), *(pa.array(np.concatenate(c)) for c in zip(*held, strict=True))], ["seq_id", "pos", "signature"])
                    held, which, n = [], [], 0

    return blocks(seqs, k, size, spread).mapInArrow(run, f"seq_id {kind}, pos long, signature long")


def super_kmers(seqs: DataFrame, k: int, m: int = 9, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(seq_id, start, len, signature): maximal runs of windows next to each other with one signature."""
    _check(k, m)
    kept, row = numbered(seqs.select("seq_id", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, at, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(block.as_buffer(), np.uint8)
                place, value = block_signatures(data, k, m)
                if not len(place):
                    continue
                new = np.concatenate(([True], (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1)))
                first = place[new]
                n = np.diff(np.concatenate((np.flatnonzero(new), [len(place)])))
                edge = (first == 0) & (at > 0) | (first + n == size)  # it may go on in the block before or after
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), r)), pa.array(first + at), pa.array(n), pa.array(value[new]), pa.array(edge)], ["row", "start", "n", "signature", "edge"])

    runs = blocks(kept.select(F.col(row).alias("seq_id"), "seq"), k, size, spread).mapInArrow(run, "row long, start long, n long, signature long, edge boolean")
    place = W.partitionBy("row").orderBy("start")  # of the runs at block ends, two a block at most
    goes_on = (F.lag("signature").over(place) == F.col("signature")) & (F.lag("start").over(place) + F.lag("n").over(place) == F.col("start"))
    ends = runs.where("edge").withColumn("_new", F.when(goes_on, 0).otherwise(1))
    ends = ends.withColumn("_run", F.sum("_new").over(place.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("row", "_run").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("signature").alias("signature"))
    whole = runs.where("NOT edge").select("row", "start", "n", "signature").unionByName(ends.drop("_run"))
    named = kept.select(F.col(row).alias("row"), "seq_id")
    return whole.join(named, "row").select("seq_id", "start", (F.col("n") + k - 1).alias("len"), "signature")
