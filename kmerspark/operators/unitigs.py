"""Cutting sequences into unitigs at branch edges, and keeping each once.

Defined results: those of flags.py; of equal keys the piece of the least seq_id,
nulls first, then of the earliest piece is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kmerspark.operators.blockwise import in_blocks
from kmerspark.operators.flags import each_sequence
from kmerspark.operators.flat import Flat, pieces, spans, strings
from kmerspark.operators.windows import BLOCK
from kmerspark.rows import fresh


def cut_unitigs(seqs: DataFrame, branches: DataFrame, kp1: int, inner_over: int = 0, **kw) -> DataFrame:
    """seqs(seq, ...) with, in place of seq, (idx, start, outer, unitig), cut where an edge of branches(code) ends.

    Pieces of a clean stretch overlap by k - 1 bases; each maximal stretch of
    special characters is a piece.  Case is kept; an empty sequence is one empty
    piece.  outer: it is the first or the last of its sequence.  Other pieces of at
    most ``inner_over`` characters are left out, and ids stay.
    """

    def make(flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        p = pieces(flat, kp1)
        idx = np.arange(len(p.row)) - np.searchsorted(p.row, p.row)
        last = np.append(p.row[1:] != p.row[:-1], True) if len(p.row) else np.zeros(0, bool)
        outer = (idx == 0) | last
        kept = outer | (p.end - p.start > inner_over)
        row, start, size = p.row[kept], p.start[kept], (p.end - p.start)[kept]
        return row, [pa.array(idx[kept]), pa.array(start - flat.begin[row]), pa.array(outer[kept]), strings(flat.chars[spans(start, size)], size)]

    return each_sequence(seqs, branches, kp1, make, StructType().add("idx", "long").add("start", "long").add("outer", "boolean").add("unitig", "string"), **kw)


def cut_unitigs_blocks(seqs: DataFrame, branches: DataFrame, kp1: int, size: int = BLOCK, **kw) -> DataFrame:
    """cut_unitigs() of sequences of any length, by blocks of ``size`` characters that all tasks share."""
    carried = [c for c in seqs.columns if c != "seq"]

    def parts(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[pa.Array]]]:
        p = pieces(flat, kp1)
        return p.row, p.start, p.end, p.goes_on, lambda pick: [strings(flat.chars[spans(p.start[pick], p.end[pick] - p.start[pick])], p.end[pick] - p.start[pick])]

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "unitig"))), lambda x: x["unitig"]), "").alias("unitig")
    own = fresh("own_row", carried)  # a row of theirs need not tell rows apart
    rows = seqs.withColumnRenamed("row", own) if "row" in carried else seqs
    whole = in_blocks(rows, branches, kp1, size, parts, StructType().add("unitig", "string"), text, **kw)
    outer = (F.col("id") == 0) | (F.col("id") == F.col("total") - 1)
    return whole.select(*[F.col("carried")[own if c == "row" else c].alias(c) for c in carried], F.col("id").alias("idx"), "start", outer.alias("outer"), "unitig")


def dedup_unitigs(unitigs: DataFrame, k: int) -> DataFrame:
    """The outer pieces, and each inner piece over k long whose first k-mer no earlier inner piece has.

    Earlier is by (seq_id, idx) over the whole input.  The earliest is kept by an
    aggregate with partial minima, so a k-mer that most pieces start with costs a row a task.
    """
    first = F.upper(F.substring("unitig", 1, k))
    key = F.when(first.rlike("[^ACGT]"), F.concat(F.lit("special:"), F.substring(first, k, 1) == "-")).otherwise(first)
    order, own = ["seq_id", "idx", *[c for c in unitigs.columns if c not in ("seq_id", "idx")]], fresh("_own", unitigs.columns)
    # outer pieces are groups of their own, so that pieces are made once
    asked = unitigs.where(F.col("outer") | (F.length("unitig") > k)).withColumn(own, F.when(F.col("outer"), F.monotonically_increasing_id()))
    return asked.groupBy(F.when(~F.col("outer"), key).alias("key"), own).agg(F.min(F.struct(*order)).alias("u")).select(*[F.col("u")[c].alias(c) for c in unitigs.columns])


def to_text(unitigs: DataFrame) -> DataFrame:
    """unitigs with, in place of unitig, record: the text headed by >idx|start|name; the name is seq_id where there is none."""
    name = F.col("name") if "name" in unitigs.columns else F.col("seq_id").cast("string")
    head = F.concat_ws("|", F.concat(F.lit(">"), F.col("idx")), "start", F.coalesce(name, F.lit("")))
    return unitigs.withColumn("record", F.concat(head, F.lit("\n"), "unitig", F.lit("\n"))).drop("unitig")
