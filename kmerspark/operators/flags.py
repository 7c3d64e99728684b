"""Sequences with the places of their branches, and what is done to them row by row.

Defined results: a null seq counts as an empty one; rows that share a seq_id, or
have none, are sequences of their own; columns of seqs besides seq are carried
along to what is made of a row, whatever their names but those made; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kmerspark.operators import edgebits
from kmerspark.operators.flat import Flat, strings
from kmerspark.operators.graph import branch_positions
from kmerspark.rows import fresh, numbered
from kmerspark.scratch import materialize

#: Codes of a branch set that are broadcast at most, 8 bytes each, and bytes of sequences that a slice has at most:
#: what is made of a byte may take a thousand.  each_sequence looks at fewer together, as it is no slower.
MAX_SET = 8_000_000
TOGETHER = 1 << 19
LOOKED_AT = 1 << 17

#: What is made of rows: the row of each thing made, and the columns added.
Make = Callable[[Flat], tuple[np.ndarray, list[pa.Array]]]


def each_sequence(seqs: DataFrame, branches: DataFrame | None, kp1: int, make: Make, added: StructType, max_set: int = MAX_SET, block: Sequence[str] = ()) -> DataFrame:
    """What make gives for the rows of seqs(seq, ...), in which branches are marked: the other columns of seqs, then the added ones.

    Up to max_set codes of branches(code), by count, are broadcast as a sorted
    array and looked up inside the row; nothing is shuffled.  Sets of edges of at
    most 15 bases that are larger, or are given as bits (edgebits), are broadcast
    as bits, at most 128 MB.  Beyond that windows and branches meet in a shuffle,
    under the row's own written number; with max_set of 0 they always do.  block:
    the columns that say of a block what Flat has to know of it.
    """
    spark, carried = seqs.sparkSession, [c for c in seqs.columns if c != "seq" and c not in block]
    text, place = F.coalesce("seq", F.lit("")).alias("seq"), fresh("_at", carried)
    shared = None
    if branches is None:
        rows = seqs.select(*carried, *block, text, F.array().cast("array<int>").alias(place))
    else:
        bits = branches if edgebits.is_bits(branches) and max_set else None
        if bits is None:
            codes = edgebits.to_codes(branches, kp1) if edgebits.is_bits(branches) else materialize(branches.select("code").distinct(), "branches")
            few = codes.limit(max_set + 1).count() <= max_set
            bits = edgebits.of_codes(codes, kp1) if not few and max_set and edgebits.fits(kp1) else None
        if bits is not None or few:
            shared = spark.sparkContext.broadcast(np.sort(codes.toArrow().column(0).to_numpy()) if bits is None else edgebits.collected(bits, kp1))
            rows = seqs.select(*carried, *block, text, F.lit(None).cast("array<int>").alias(place))
        else:
            kept, row = numbered(seqs)
            at = branch_positions(kept.select(F.col(row).alias("seq_id"), "seq"), codes, kp1).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias(place)).withColumnRenamed("seq_id", row)
            rows = kept.join(at, row, "left").select(*carried, *block, text, F.coalesce(place, F.array().cast("array<int>")).alias(place))
    n_carried, n_block = len(carried), len(block)
    schema = StructType(rows.schema.fields[:n_carried] + added.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, n_carried + n_block, LOOKED_AT):
                flat = Flat(b.column(n_carried + n_block), *(c.to_numpy(zero_copy_only=False) for c in b.columns[n_carried : n_carried + n_block]))
                if shared is not None:
                    flat.mark(shared.value, kp1)
                else:
                    at = b.column(n_carried + n_block + 1)
                    flat.branch[np.repeat(flat.begin, np.diff(at.offsets.to_numpy())) + at.flatten().to_numpy()] = True
                    flat.branch &= flat.inside()
                row, columns = make(flat)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns[:n_carried]), *columns], names)

    return rows.mapInArrow(run, schema)


def _slices(b: pa.RecordBatch, text: int, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text."""
    if not b.num_rows:
        return
    at = np.frombuffer(b.column(text).buffers()[1], np.int32)[b.column(text).offset :][: b.num_rows + 1].astype(np.int64)
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + together, "right")) - 1)
        yield b.slice(first, last - first)
        first = last


def flag_branches(seqs: DataFrame, branches: DataFrame, kp1: int, **kw) -> DataFrame:
    """seqs with, in place of seq, flagged: seq with the base at each branch replaced by its digit."""

    def make(flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        chars = np.where(flat.branch, 48 + flat.base, flat.chars).astype(flat.chars.dtype)
        inside = flat.inside()
        return np.arange(flat.n), [strings(chars[inside], flat.end - flat.first)]

    return each_sequence(seqs, branches, kp1, make, StructType().add("flagged", "string"), **kw)
