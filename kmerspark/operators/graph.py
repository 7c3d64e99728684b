"""The de Bruijn graph: k+1-mers as edges from their first k bases to their last k.

Branching is found by one partial aggregate on the shared k-mer, whose state is
a count and four bits; no edge is held, so a k-mer with a third of all edges
costs its reducer a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.functions import codec
from kmerspark.functions.codec import check_k
from kmerspark.operators import edgebits
from kmerspark.operators.windows import COUNTED, block_codes, blocks, kmer_codes, kmer_counts


def _bit(base: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), base.cast("int"))


def edge_rows(seqs: DataFrame, kp1: int, spread: bool = False) -> DataFrame:
    """(code) of the edges of seqs(seq_id, seq), each once for every batch of windows that holds it: for what reads repeated rows as one."""
    return kmer_counts(seqs, kp1, spread=spread).select("code")


def successor_masks(edges: DataFrame) -> DataFrame:
    """(kmer, mask): bit b is set if the k-mer goes on with base b; a table of these is handed back as it is."""
    if "mask" in edges.columns:
        return edges
    return edges.groupBy(codec.prefix("code").alias("kmer")).agg(F.bit_or(_bit(codec.last_base("code"))).alias("mask"))


def _branching(edges: DataFrame, node: Column, base: Column, distinct: bool, edge) -> DataFrame:
    """Edges of nodes with more than one row, or more than one distinct edge."""
    seen = edges.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(_bit(base)).alias("mask"))
    seen = seen.where(F.bit_count("mask") > 1 if distinct else F.col("n") > 1)
    bases = F.filter(F.array(*map(F.lit, range(4))), lambda b: F.col("mask").bitwiseAND(_bit(b)) != 0)
    return seen.select("node", F.explode(bases).alias("base")).select(edge(F.col("node"), F.col("base").cast("long")).alias("code"))


def multi_out(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(code) of the distinct edges that leave a k-mer with several rows of edges(code).

    With ``distinct`` repeated rows count once, so windows can be given as they are.
    """
    return _branching(edges, codec.prefix("code"), codec.last_base("code"), distinct, lambda node, base: F.shiftleft(node, 2).bitwiseOR(base))


def multi_in(edges: DataFrame, kp1: int, distinct: bool = False) -> DataFrame:
    """(code) of the distinct edges that enter a k-mer with several rows of edges(code)."""
    return _branching(edges, codec.suffix("code", kp1 - 1), codec.first_base("code", kp1), distinct, lambda node, base: F.shiftleft(base, 2 * (kp1 - 1)).bitwiseOR(node))


def branches(seqs: DataFrame, kp1: int, out: bool = True, into: bool = False, spread: bool = False) -> DataFrame:
    """(code) of the edges of seqs(seq_id, seq) that leave a k-mer with several, or (into) enter one; each once a side.

    The batches of windows are folded by k-mer where they are made, to four bits a
    side; the k-mers are sorted by Spark, so that a task merges their bits as they
    stream by and holds none of them.
    """
    k = check_k(kp1) - 1
    low = np.uint64((1 << 2 * k) - 1)

    def folded(codes: list[np.ndarray]) -> pa.RecordBatch:
        code = np.unique(np.concatenate(codes)).view(np.uint64)
        keys, bits = [], []
        for side in [0] * out + [1] * into:
            node, base = (code & low, code >> np.uint64(2 * k)) if side else (code >> np.uint64(2), code & np.uint64(3))
            order = np.argsort(node, kind="stable")  # codes below zero come first
            node, bit = node[order], np.left_shift(1, base[order].astype(np.int64))
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            keys.append((node[first] << np.uint64(1) | np.uint64(side)).view(np.int64))
            bits.append(np.bitwise_or.reduceat(bit, first).astype(np.int8))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(bits))], ["key", "bits"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for block in b.column(0):
                held.append(block_codes(np.frombuffer(block.as_buffer(), np.uint8), kp1)[1])
                n += len(held[-1])
                if n >= COUNTED:
                    yield folded(held)
                    held, n = [], 0
        if n:
            yield folded(held)

    def several(key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        many = bits & (bits - 1) != 0
        node, side, bits = key[many].view(np.uint64) >> np.uint64(1), key[many] & 1, bits[many]
        codes = [np.where(side == 1, np.uint64(b) << np.uint64(2 * k) | node, node << np.uint64(2) | np.uint64(b))[bits >> b & 1 == 1] for b in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64))], ["code"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_bits = np.zeros(0, np.int64), np.zeros(0, np.int8)
        for b in batches:
            key, bits = np.concatenate((last_key, b.column(0).to_numpy())), np.concatenate((last_bits, b.column(1).to_numpy()))
            if len(key):
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, bits = key[first], np.bitwise_or.reduceat(bits, first)
                last_key, last_bits = key[-1:], bits[-1:]  # it may go on in the next batch
                yield several(key[:-1], bits[:-1])
        yield several(last_key, last_bits)

    rows = blocks(seqs, kp1, spread=spread).select("block").mapInArrow(fold, "key long, bits byte")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "code long")


def branch_set(seqs: DataFrame, kp1: int, out: bool = True, into: bool = False, spread: bool = False) -> DataFrame:
    """branches() as the operators on sequences take them: as bits where edges have up to 15 bases, else as codes."""
    make = edgebits.of_sequences if edgebits.fits(kp1) else branches
    return make(seqs, kp1, out=out, into=into, spread=spread)


def branches_of_masks(masks: DataFrame) -> DataFrame:
    """(code) of the edges that leave a k-mer with several, from successor_masks(); nothing is shuffled."""
    bases = F.filter(F.array(*map(F.lit, range(4))), lambda b: F.col("mask").cast("int").bitwiseAND(_bit(b)) != 0)
    each = masks.where(F.bit_count("mask") > 1).select("kmer", F.explode(bases).alias("base"))
    return each.select(F.shiftleft("kmer", 2).bitwiseOR(F.col("base").cast("long")).alias("code"))


def endpoints(edges: DataFrame, kp1: int) -> DataFrame:
    """(code, source, target) with the k-mers' codes."""
    return edges.select("code", codec.prefix("code").alias("source"), codec.suffix("code", kp1 - 1).alias("target"))


def branch_positions(seqs: DataFrame, branches: DataFrame, kp1: int) -> DataFrame:
    """(seq_id, pos, code): windows that are branch edges; pos is the window's last base.  Spark picks the join by the set's size."""
    windows = kmer_codes(seqs, kp1)
    return windows.join(branches.select("code").distinct(), "code", "left_semi").select("seq_id", (F.col("pos") + kp1 - 1).alias("pos"), "code")
