"""Sets of edges as bits, one for each possible code: for edges of up to 15 bases a set of any size has 128 MB at most.

The bits are cut into chunks of a row each, with a row's zeros squeezed out.  Edges
that leave one k-mer are four bits next to each other; those that enter one are the
bits at one place of the four chunks whose numbers differ in their first base, and
these meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerspark.operators.windows import BATCH, block_codes, blocks
from kmerspark.scratch import materialize

#: Bases of an edge, and bits of a chunk at most.
LEAST, MOST, CHUNK = 3, 15, 1 << 20
SCHEMA = "grp int, chunk int, bits binary"
#: The bits of a byte that are not alone among the four of their k-mer.
_SEVERAL = np.array([sum(part for part in (x & 15, x & 240) if part & (part - 1)) for x in range(256)], np.uint8)


def fits(kp1: int) -> bool:
    return LEAST <= kp1 <= MOST


def _chunk(kp1: int) -> int:
    """Bits of a chunk: there are four chunks at least."""
    return min(CHUNK, 4 ** (kp1 - 1))


class Bits:
    """A set of codes that says of each of many whether it has it."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, codes: np.ndarray) -> np.ndarray:
        return (self.data[codes >> 3] >> (codes & 7).astype(np.uint8) & 1).astype(bool)

    def masks(self, nodes: np.ndarray) -> np.ndarray:
        """The bases that each k-mer goes on with, as bits."""
        return self.data[nodes >> 1] >> ((nodes & 1) << 2).astype(np.uint8) & 15


def _set(data: np.ndarray, codes: np.ndarray) -> None:
    codes = np.sort(codes)
    byte = codes >> 3
    first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
    data[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, codes & 7).astype(np.uint8), first)


def _rows(data: np.ndarray, kp1: int) -> Iterator[pa.RecordBatch]:
    size = _chunk(kp1) // 8
    groups = len(data) // size // 4
    for c in range(len(data) // size):
        part = data[c * size : (c + 1) * size]
        if part.any():
            yield _batch(c % groups, c, part)


def _batch(grp: int, chunk: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["grp", "chunk", "bits"])


def _merged(parts: DataFrame, kp1: int, out: bool, into: bool) -> DataFrame:
    """A row a chunk of all that parts(grp, chunk, bits) have; out, into: only edges that leave, or enter, a k-mer with several."""
    size = _chunk(kp1) // 8
    groups = 4**kp1 // 8 // size // 4

    def done(grp: int, four: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = four if not (out or into) else np.zeros_like(four)
        if out:
            kept |= _SEVERAL[four]
        if into:
            once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            for part in four:
                twice |= once & part
                once |= part
            kept |= four & twice
        for i in range(4):
            if kept[i].any():
                yield _batch(grp, grp + i * groups, kept[i])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, four = None, np.zeros((4, size), np.uint8)
        for b in batches:
            for grp, chunk, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if grp != now:
                    if now is not None:
                        yield from done(now, four)
                    now, four = grp, np.zeros((4, size), np.uint8)
                four[chunk // groups] |= np.frombuffer(zlib.decompress(bits.as_buffer()), np.uint8)
        if now is not None:
            yield from done(now, four)

    return parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(merge, SCHEMA)


def _folded(batches: Iterator[pa.RecordBatch], kp1: int) -> Iterator[pa.RecordBatch]:
    """The bits of all windows of blocks, so many of which are set at once that their codes are a few megabytes."""
    data, held, n = np.zeros(4**kp1 // 8, np.uint8), [], 0
    for b in batches:
        for block in b.column(0):
            held.append(block_codes(np.frombuffer(block.as_buffer(), np.uint8), kp1)[1])
            n += len(held[-1])
            if n >= BATCH:
                _set(data, np.concatenate(held))
                held, n = [], 0
    if n:
        _set(data, np.concatenate(held))
    yield from _rows(data, kp1)


def of_sequences(seqs: DataFrame, kp1: int, out: bool = False, into: bool = False, spread: bool = False) -> DataFrame:
    """The edges of seqs(seq_id, seq) as bits, written; out, into: only those that leave a k-mer with several, or enter one.

    A task has the bits of its own windows, and sends on the chunks that have any.
    """

    parts = blocks(seqs, kp1, spread=spread).select("block").mapInArrow(lambda batches: _folded(batches, kp1), SCHEMA)
    return materialize(_merged(parts, kp1, out, into), "bits")


def of_codes(codes: DataFrame, kp1: int) -> DataFrame:
    """The edges of codes(code) as bits, written."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(4**kp1 // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                _set(data, b.column(0).to_numpy())
        yield from _rows(data, kp1)

    return materialize(_merged(codes.select("code").mapInArrow(fold, SCHEMA), kp1, False, False), "bits")


def several(bits: DataFrame, kp1: int, out: bool = True, into: bool = False) -> DataFrame:
    """Those edges of the set that leave a k-mer with several, or (into) enter one, written."""
    return materialize(_merged(bits, kp1, out, into), "bits")


def is_bits(table: DataFrame) -> bool:
    return "bits" in table.columns


def to_codes(bits: DataFrame, kp1: int) -> DataFrame:
    """(code) of each edge of the set."""
    chunk = _chunk(kp1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(zlib.decompress(part.as_buffer()), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.unpackbits(data, bitorder="little")) + c * chunk)], ["code"])

    return bits.select("chunk", "bits").mapInArrow(run, "code long")


def collected(bits: DataFrame, kp1: int) -> Bits:
    """The set in this process, to be broadcast; its chunks come one after the other."""
    data, size = np.zeros(4**kp1 // 8, np.uint8), _chunk(kp1) // 8
    for row in bits.select("chunk", "bits").coalesce(8).toLocalIterator():
        data[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return Bits(data)
