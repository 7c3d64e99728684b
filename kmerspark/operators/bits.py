"""Runs as the bits of a canonical Huffman code, in blocks that are decoded apart from each other.

A run is written as the digits of its length to base 4, lowest first, each plus
256, and then its value, as compress.symbols counts them.  A block is a row of its
own with what it needs: where its first run starts, how many runs and bits it has,
and the bits.

Defined results: a null or empty string has no block; a value that could be taken
for a digit, or that the code has no word for, raises; an empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerspark.operators.compress import codebook, symbols

#: Runs of a block, and bits of the longest codeword.
RUNS, LONGEST = 1 << 12, 56


def run_code(runs: DataFrame) -> dict[int, str]:
    """The canonical code of runs(value, length): a word for each digit and character that occurs, counted by Spark."""
    book = codebook({r.symbol: r.n for r in symbols(runs).collect()})
    if max(map(len, book.values()), default=0) > LONGEST:
        raise ValueError(f"a codeword of over {LONGEST} bits")
    return book


def _written(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The symbols of runs one after the other."""
    if ((value >= 256) & (value < 260)).any():
        raise ValueError("a value that stands for a digit")
    n = max(1, (int(length.max()).bit_length() + 1) // 2) if len(length) else 1
    digits = length[:, None] >> 2 * np.arange(n)
    return np.concatenate((np.where(digits > 0, 256 + (digits & 3), -1), value[:, None]), axis=1).ravel()


def encode_runs(rows: DataFrame, book: dict[int, str], runs: int = RUNS) -> DataFrame:
    """(row, part, start, runs, bits, data) of rows(row, s): the string's runs, so many a block."""
    known = np.array(sorted(book), np.int64)
    word, size = np.array([int(book[s], 2) for s in known.tolist()], np.int64), np.array([len(book[s]) for s in known.tolist()], np.int64)
    kind = rows.schema["row"].dataType.simpleString()

    def pack(value: np.ndarray, length: np.ndarray) -> tuple[int, bytes]:
        written = _written(value, length)
        written = written[written >= 0]
        i = np.minimum(np.searchsorted(known, written), len(known) - 1)
        if not len(known) or (known[i] != written).any():
            raise ValueError("the code has no word for a symbol")
        own = size[i]
        last = np.repeat(np.cumsum(own), own)
        bit = np.repeat(word[i], own) >> last - 1 - np.arange(int(own.sum())) & 1
        return len(bit), np.packbits(bit.astype(np.uint8)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple] = []
            for i in range(b.num_rows):
                points = np.frombuffer((b.column(1)[i].as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                if len(points):
                    start = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1])))
                    length = np.diff(np.append(start, len(points)))
                    made += [(i, at // runs, int(start[at]), len(start[at : at + runs]), *pack(points[start[at : at + runs]], length[at : at + runs])) for at in range(0, len(start), runs)]
            row, *columns = zip(*made, strict=True) if made else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], ["row", "part", "start", "runs", "bits", "data"])

    return rows.select("row", "s").mapInArrow(run, f"row {kind}, part long, start long, runs long, bits long, data binary")


def decode_runs(blocks: DataFrame, book: dict[int, str]) -> DataFrame:
    """(row, start, value, length) of the runs in blocks of encode_runs, each block by itself."""
    order = sorted(book, key=lambda s: (len(book[s]), s))
    longest = max(map(len, book.values()), default=1)
    # canonical words, filled up to one width, are in order
    low = np.array([int(book[s], 2) << longest - len(book[s]) for s in order], np.int64)
    size, symbol = np.array([len(book[s]) for s in order], np.int64), np.array(order, np.int64)
    kind = blocks.schema["row"].dataType.simpleString()

    def unpack(data: bytes, bits: int) -> np.ndarray:
        bit = np.concatenate((np.unpackbits(np.frombuffer(data, np.uint8))[:bits], np.zeros(longest, np.uint8))).astype(np.int64)
        window = np.zeros(bits, np.int64)
        for j in range(longest):
            window = window << 1 | bit[j : j + bits]
        here = np.searchsorted(low, window, "right") - 1  # what a word from each bit on would be
        onward, at, found = (np.arange(bits) + size[here]).tolist(), 0, []
        while at < bits:
            found.append(at)
            at = onward[at]
        if at != bits:
            raise ValueError("a block ends inside a word")
        return symbol[here[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (start, runs, bits, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "runs", "bits", "data")), strict=True)):
                s = unpack(data, bits)
                ends = np.flatnonzero((s < 256) | (s >= 260))  # of each run, its value
                if len(ends) != runs:
                    raise ValueError(f"{runs} runs declared, {len(ends)} found")
                first = np.concatenate(([0], ends[:-1] + 1))
                power = np.arange(len(s)) - np.repeat(first, ends - first + 1)
                digit = np.where((s < 256) | (s >= 260), 0, s - 256) << 2 * power
                length = np.add.reduceat(digit, first)
                at = start + np.cumsum(length) - length
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(np.full(runs, i))), pa.array(at), pa.array([chr(c) for c in s[ends]], pa.string()), pa.array(length)], ["row", "start", "value", "length"])

    return blocks.select("row", "start", "runs", "bits", "data").mapInArrow(run, f"row {kind}, start long, value string, length long")
