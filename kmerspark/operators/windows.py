"""Sequences to k-mers.

Sequences are a DataFrame with seq_id and seq (string).  A long sequence is cut
into overlapping blocks first, so memory follows the block and not the sequence;
with ``spread`` the blocks are dealt to all tasks, so that one chromosome is many
tasks' work (its text is shuffled once).  The codes of a block are built in
arrays, by doubling the length of what they cover.

Defined results: a null seq counts as an empty one, and has no windows, like one
shorter than k; rows that share a seq_id, or have none, are sequences of their
own, whose windows are all there under that id; an empty table has no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerspark.functions.codec import check_k

BLOCK = 1 << 16
#: Windows that a task hands back at once, and that it counts at once.
BATCH = 1 << 18
COUNTED = 1 << 21
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[[_b, _b + 32]] = _i


def block_codes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the windows of k bytes that hold bases only."""
    return base_windows(_CODE[data], k)


def base_windows(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of an array of 0 to 3 for bases and 4 for all else."""
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    special = np.concatenate(([0], np.cumsum(base > 3)))
    clean = np.flatnonzero(special[k:] == special[:-k])
    have, width = 0, 1
    power = (base & 3).astype(np.uint64)  # codes of `width` bases from each place
    while have < k:  # k as a sum of powers of two, lowest first
        if k & width:
            step = power[have : have + n]
            codes = step if not have else (codes << np.uint64(2 * width)) | step
            have += width
        width *= 2
        if have < k:
            half = width // 2
            power = (power[: len(power) - half] << np.uint64(2 * half)) | power[half:]
    return clean, codes[:n][clean].view(np.int64)


def blocks(seqs: DataFrame, k: int, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(seq_id, at, block): stretches of the sequences that start every ``size`` places and overlap by k - 1."""
    plain = F.when(F.octet_length("seq") == F.length("seq"), F.col("seq")).otherwise(F.regexp_replace("seq", r"[^\x00-\x7F]", "N"))
    whole = seqs.select("seq_id", plain.cast("binary").alias("seq"), F.length("seq").alias("n"))
    # short ones are left out here, as a filter would go below what seq is made by and make it twice
    starts = F.when(F.col("n") >= k, F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(k)) - k, F.lit(size)))
    cut = F.transform(starts, lambda at: F.struct(at.cast("long").alias("at"), F.substring("seq", at + 1, F.lit(size + k - 1)).alias("block")))
    rows = whole.select("seq_id", F.explode(cut).alias("x")).select("seq_id", "x.at", "x.block")
    return rows.repartition("seq_id", "at") if spread else rows


def kmer_codes(seqs: DataFrame, k: int, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(seq_id, pos, code) of every window of k bases; pos is its 0-based start."""
    check_k(k)
    kind = seqs.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, which, n = [], [], 0
            for i, at in enumerate(b.column(1).to_pylist()):
                place, code = block_codes(np.frombuffer(b.column(2)[i].as_buffer(), np.uint8), k)
                held.append((place + at, code))
                which.append(np.full(len(place), i))
                n += len(place)
                if n >= BATCH or i == b.num_rows - 1:
                    if n:
                        own = b.column(0).take(pa.array(np.concatenate(which)))
                        yield pa.RecordBatch.from_arrays([own, *(pa.array(np.concatenate(c)) for c in zip(*held, strict=True))], ["seq_id", "pos", "code"])
                    held, which, n = [], [], 0

    return blocks(seqs, k, size, spread).mapInArrow(run, f"seq_id {kind}, pos long, code long")


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    """The codes held and how often each is there; they are let go, and sorted in place, so that no third copy is made."""
    code = np.concatenate(held)
    held.clear()
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(np.diff(first, append=len(code)))], ["code", "n"])


def kmer_counts(seqs: DataFrame, k: int, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(code, n): windows counted in batches where they are made; a k-mer has a row for each batch that holds it."""
    check_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for block in b.column(0):
                held.append(block_codes(np.frombuffer(block.as_buffer(), np.uint8), k)[1])
                n += len(held[-1])
                if n >= COUNTED:
                    yield _counted(held)
                    held, n = [], 0
        if n:
            yield _counted(held)

    return blocks(seqs, k, size, spread).select("block").mapInArrow(run, "code long, n long")


def kmer_strings(seqs: DataFrame, k: int, size: int = 512) -> DataFrame:
    """(seq_id, pos, kmer): the same windows as strings, by built-in functions only."""
    cut = blocks(seqs, k, size).select("seq_id", "at", "block", F.explode(F.sequence(F.lit(0), F.length("block") - k)).alias("i"))
    windows = cut.select("seq_id", (F.col("at") + F.col("i")).alias("pos"), F.upper(F.expr(f"CAST(substring(block, i + 1, {k}) AS STRING)")).alias("kmer"))
    return windows.where(F.col("kmer").rlike("^[ACGT]+$"))
