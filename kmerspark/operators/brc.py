"""Branch-only encoding of sequences, and back.

A good segment is a stretch of bases at least k+1 long; it is written as its
first k bases and then only the bases chosen at branches (or, in k-mer format,
the whole k+1-mers there).  What lies between good segments is kept as it is.

Every record carries row, the number of its sequence, by which records are
brought together again; seq_id and the other columns of a sequence come along
and may be null or repeated.

Defined results: a null seq counts as an empty one, which is one empty bad
record; rows that share a seq_id, or have none, are sequences of their own; an
empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from kmerspark.functions import codec
from kmerspark.operators import edgebits
from kmerspark.operators.blockwise import cut_blocks as cut_blocks, in_blocks
from kmerspark.operators.edgebits import Bits
from kmerspark.operators.flags import each_sequence
from kmerspark.operators.flat import Flat, Segments, bodies, segments as cut_segments
from kmerspark.operators.graph import successor_masks
from kmerspark.operators.windows import _CODE, BLOCK, kmer_codes
from kmerspark.scratch import materialize

#: Edges whose successors may be broadcast to decode; 9 bytes each.
MAX_EDGES = 50_000_000
#: Bases that a group of sequences has on average, where groups are decoded apart.
GROUP_BASES = 1 << 24


_FIELDS = StructType().add("brc_id", "long").add("len", "long").add("start", "long").add("type", "string")


def _kinds(s: Segments) -> pa.Array:
    return pa.array(["bad", "good"]).take(pa.array(s.good.astype(np.int8)))


def _record_fields(flat: Flat, s: Segments) -> list[pa.Array]:
    return [pa.array(np.arange(len(s.row)) - np.searchsorted(s.row, s.row)), pa.array(s.end - s.start), pa.array(s.start - flat.begin[s.row]), _kinds(s)]


def _with_row(seqs: DataFrame) -> DataFrame:
    return seqs if "row" in seqs.columns else seqs.withColumn("row", F.monotonically_increasing_id())


def walk(seqs: DataFrame, branches: DataFrame, kp1: int, kmer_format: bool = False, pass_special: bool = False, **kw) -> DataFrame:
    """seqs(seq, ...) with, in place of seq, (row, brc_id, len, start, type, brc); with pass_special bad records are left out and ids stay.

    row is taken from seqs if it has that column, which must then tell its rows apart.
    """

    def make(flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        s = cut_segments(flat, kp1)
        return s.row, [*_record_fields(flat, s), bodies(flat, s, kp1, kmer_format)]

    out = each_sequence(_with_row(seqs), branches, kp1, make, StructType(_FIELDS.fields[:]).add("brc", "string"), **kw)
    return out.where(F.col("type") == "good") if pass_special else out


def walk_blocks(seqs: DataFrame, branches: DataFrame, kp1: int, kmer_format: bool = False, pass_special: bool = False, size: int = BLOCK, **kw) -> DataFrame:
    """walk() of sequences of any length, by blocks of ``size`` characters that all tasks share."""

    def parts(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[pa.Array]]]:
        s = cut_segments(flat, kp1)

        def columns(pick: np.ndarray) -> list[pa.Array]:
            own = Segments(s.row[pick], s.start[pick], s.end[pick], s.good[pick], s.goes_on[pick])
            return [pa.array(own.end - own.start), _kinds(own), bodies(flat, own, kp1, kmer_format)]

        return s.row, s.start, s.end, s.goes_on, columns

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "brc"))), lambda x: x["brc"]), "").alias("brc")
    added = StructType().add("len", "long").add("type", "string").add("brc", "string")
    whole = in_blocks(seqs, branches, kp1, size, parts, added, F.sum("len").alias("len"), F.min("type").alias("type"), text, **kw)
    whole = whole.where("type = 'good'") if pass_special else whole
    return whole.select(*[F.col("carried")[c].alias(c) for c in seqs.columns if c not in ("seq", "row")], "row", F.col("id").alias("brc_id"), "len", "start", "type", "brc")


def segments(seqs: DataFrame, kp1: int) -> DataFrame:
    """seqs(seq, ...) with, in place of seq, (brc_id, len, start, type): no graph is needed for them, and nothing is shuffled."""

    def make(flat: Flat) -> tuple[np.ndarray, list[pa.Array]]:
        s = cut_segments(flat, kp1)
        return s.row, _record_fields(flat, s)

    return each_sequence(seqs, None, kp1, make, _FIELDS)


#: The base that a mask with one bit stands for.
_FORCED = np.array([0, 0, 1, 0, 2, 0, 0, 0, 3] + [0] * 7, np.int64)
#: Records that are left when each is decoded alone: a step of fewer costs more in arrays than base by base.
ALONE = 24
#: Bytes of records, before and after, that are decoded together.
TOGETHER = 1 << 21


class Sorted:
    """Sorted codes (as signed longs) of k-mers with their masks, or of edges, with what edgebits.Bits answers."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None):
        self.codes, self._masks = codes, masks

    def has(self, codes: np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def masks(self, nodes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(nodes), np.uint8)
        i = np.minimum(np.searchsorted(self.codes, nodes), len(self.codes) - 1)
        return np.where(self.codes[i] == nodes, self._masks[i], np.uint8(0))


def _mask_of(graph: Sorted | Bits) -> Callable[[int], int]:
    """The mask of one k-mer, 0 where it has none."""
    if isinstance(graph, Bits):
        data = memoryview(graph.data)
        return lambda node: data[node >> 1] >> ((node & 1) << 2) & 15
    nodes, masks = memoryview(graph.codes), memoryview(graph._masks)

    def mask(node: int) -> int:
        i = bisect_left(nodes, node)
        return masks[i] if i < len(nodes) and nodes[i] == node else 0

    return mask


def _has_one(own: Sorted | Bits) -> Callable[[int], bool]:
    if isinstance(own, Bits):
        data = memoryview(own.data)
        return lambda edge: bool(data[edge >> 3] >> (edge & 7) & 1)
    codes = memoryview(own.codes)

    def has(edge: int) -> bool:
        edge -= (edge >> 63) << 64  # as a signed long
        i = bisect_left(codes, edge)
        return i < len(codes) and codes[i] == edge

    return has


def _rest_of_record(out: np.ndarray, node: int, items: np.ndarray, low: int, step: int, mask_of: Callable[[int], int], has: Callable[[int], bool] | None) -> None:
    """Fill out with the bases that follow k-mer node; items: what is left of the record's text, as codes."""
    given, made, at = items.tobytes(), bytearray(len(out)), step - 1
    forced = _FORCED.tolist()
    for t in range(len(made)):
        mask = mask_of(node)
        if not mask:
            raise ValueError("no successor: the edges are not those of the encoded sequence")
        if mask & (mask - 1):
            if at >= len(given):
                raise ValueError("a record ends before its length is reached")
            base = given[at]
            at += step
        else:
            base = forced[mask]
            if has is not None and has(node << 2 | base):
                at += step
        made[t] = base
        node = (node << 2 | base) & low
    out[:] = np.frombuffer(bytes(made), np.uint8)


def decode_records(brcs: list[str], lengths: list[int], k: int, graph: Sorted | Bits, own: Sorted | Bits | None, kmer_format: bool) -> list[str]:
    """The bases of good records, decoded in step, one look-up a base for all that are not done; the last and longest few alone.

    own: None if the records were written with all multi-out edges, whose k-mers
    have several successors; else the set that they were written with, and an item
    is skipped also where a forced edge is in the set.
    """
    step, low = (k + 1 if kmer_format else 1), (1 << 2 * k) - 1
    order = sorted(range(len(brcs)), key=lambda i: -lengths[i])
    n = np.array([lengths[i] for i in order], np.int64)
    size = np.array([len(brcs[i]) for i in order], np.int64)
    given = _CODE[np.frombuffer("".join(brcs[i] for i in order).encode(), np.uint8)]
    end = np.cumsum(size)
    at, to = end - size, np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    if (size < k).any() or (n < k).any():
        raise ValueError("a record is shorter than k")
    node = np.zeros(len(n), np.int64)
    for t in range(k):
        out[to + t] = given[at]
        node = node << 2 | given[at]
        at += 1
    shorter = -n
    for t in range(k, int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(shorter, -t))  # the first m are longer than t
        if m <= ALONE:
            mask_of, has = _mask_of(graph), None if own is None else _has_one(own)
            for j in range(m):
                _rest_of_record(out[to[j] + t : to[j] + n[j]], int(node[j]), given[at[j] : end[j]], low, step, mask_of, has)
            break
        at_node = node[:m]
        mask = graph.masks(at_node)
        if not mask.all():
            raise ValueError("no successor: the edges are not those of the encoded sequence")
        many = (mask & (mask - 1)) != 0
        base = _FORCED[mask]
        item = at[:m] + step - 1
        if (item[many] >= end[:m][many]).any():
            raise ValueError("a record ends before its length is reached")
        base[many] = given[item[many]]
        edge = at_node << 2 | base
        used = many if own is None else many | own.has(edge)
        at[:m] += step * used
        out[to[:m] + t] = base
        node[:m] = edge & low
    text = np.frombuffer(codec.BASES.encode(), np.uint8)[out].tobytes().decode()
    made = [""] * len(brcs)
    for j, i in enumerate(order):
        made[i] = text[to[j] : to[j] + n[j]]
    return made


def restore_records(brcs: list[str], lengths: list[int], k: int, nodes: np.ndarray, masks: np.ndarray, branches: np.ndarray | None, kmer_format: bool) -> list[str]:
    """decode_records() with sorted codes, as signed longs, of k-mers and of the branch set."""
    return decode_records(brcs, lengths, k, Sorted(nodes, masks), None if branches is None else Sorted(branches), kmer_format)


def _graph_as_bits(edges: DataFrame, kp1: int, max_edges: int) -> DataFrame | None:
    """The edges as bits, where they are given so, or where bits take no more memory than the successors of max_edges k-mers."""
    if edgebits.is_bits(edges):
        return edges
    size = 4**kp1 // 8
    if not edgebits.fits(kp1) or size > 9 * max_edges:
        return None
    return edgebits.of_codes(edges, kp1)


def restore(brcs: DataFrame, edges: DataFrame, kp1: int, kmer_format: bool = False, branch_set: DataFrame | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """The sequences (seq, and the columns that walk carried along) from walk's records and the graph's edges(code).

    Every base depends on the k before it, so a record is decoded in one pass by
    one task, along with the others of its batch, against the successors of all
    k-mers.  Edges of at most 15 bases are broadcast as bits, at most 128 MB.
    Others as two sorted arrays, once their number is checked; past ``max_edges``
    this raises, and chains.restore_chains or restore_by_group is the way.
    The edges are read when this is called; they may be given as bits.
    """
    k, spark = kp1 - 1, brcs.sparkSession
    bits = _graph_as_bits(edges, kp1, max_edges)
    if bits is not None:
        graph = edgebits.collected(bits, kp1)
    else:
        succ = materialize(successor_masks(edges).select("kmer", F.col("mask").cast("byte").alias("mask")), "successors", "zstd")
        n = succ.count()
        if n > max_edges:
            raise ValueError(f"{n} k-mers have successors; at most {max_edges} are broadcast")
        table = succ.toArrow()
        order = np.argsort(table.column(0).to_numpy())
        graph = Sorted(table.column(0).to_numpy()[order], table.column(1).to_numpy().astype(np.uint8)[order])
    own = None
    if branch_set is not None:
        bits = _graph_as_bits(branch_set, kp1, max_edges)
        if bits is None and (n := (codes := materialize(branch_set.select("code").distinct(), "branches")).count()) > max_edges:
            raise ValueError(f"{n} branches; at most {max_edges} are broadcast")
        own = edgebits.collected(bits, kp1) if bits is not None else Sorted(np.sort(codes.toArrow().column(0).to_numpy()))
    shared = spark.sparkContext.broadcast((graph, own))
    rows, carried = _to_decode(brcs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _cut(b):
                yield _decode(piece, k, *shared.value, kmer_format)

    return _sequences(rows.mapInArrow(run, _pieces(rows)), carried)


def _to_decode(brcs: DataFrame, *keys: str) -> tuple[DataFrame, list[str]]:
    """Records with what comes along as one column, and the names of that."""
    carried = [c for c in brcs.columns if c not in ("brc_id", "len", "start", "type", "brc", "row")]
    return brcs.select("row", "brc_id", "len", "type", "brc", F.struct(F.lit(True).alias("_"), *carried).alias("carried"), *keys), carried


def _pieces(rows: DataFrame) -> StructType:
    return StructType([rows.schema["row"], rows.schema["brc_id"]]).add("piece", "string").add(rows.schema["carried"])


def _cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of _to_decode in pieces of about TOGETHER bytes, so that memory does not follow the length of records."""
    size = np.cumsum([n + len(text) for n, text in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)])
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + TOGETHER, "right")))
        yield b.slice(first, last - first)
        first = last


def _decode(b: pa.RecordBatch | pa.Table, k: int, graph: Sorted | Bits, own: Sorted | Bits | None, kmer_format: bool) -> pa.RecordBatch | pa.Table:
    """The rows of _to_decode as those of _pieces; bad records are their own text."""
    n, kinds, out = (b.column(i).to_pylist() for i in (2, 3, 4))
    good = [i for i, kind in enumerate(kinds) if kind == "good"]
    for i, text in zip(good, decode_records([out[i] for i in good], [n[i] for i in good], k, graph, own, kmer_format), strict=True):
        out[i] = text
    return type(b).from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), b.column(5)], ["row", "brc_id", "piece", "carried"])


def _sequences(pieces: DataFrame, carried: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("brc_id", "piece")))
    # a record that is first in its sequence is enough to say what comes along
    whole = pieces.groupBy("row").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"), F.min_by("carried", "brc_id").alias("carried"))
    return whole.select("row", *[F.col("carried")[c].alias(c) for c in carried], "seq")


def with_groups(seqs: DataFrame, bases: int = GROUP_BASES) -> DataFrame:
    """seqs(row, seq, ...) with grp, by a hash of row, so many that one has ``bases`` bases on average.

    row must tell the rows apart, and be the same whenever seqs is read, so of a
    written table.  A sequence is in one group, however long.  The bases are
    counted when this is called.
    """
    total = seqs.agg(F.sum(F.length("seq")).alias("n")).first().n or 0
    return seqs.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(-(-total // bases) or 1)))


def group_edges(seqs: DataFrame, branches: DataFrame, kp1: int) -> DataFrame:
    """(grp, code, branch) of the distinct edges of each group of seqs(grp, seq), and whether they are in the branch set of all.

    Written beside the records, it is what restore_by_group reads in place of the graph.
    """
    edges = kmer_codes(seqs.select(F.col("grp").alias("seq_id"), "seq"), kp1).select(F.col("seq_id").alias("grp"), "code").distinct()
    marked = branches.select("code").distinct().withColumn("_in", F.lit(True))
    return edges.join(marked, "code", "left").select("grp", "code", F.col("_in").isNotNull().alias("branch"))


def restore_by_group(brcs: DataFrame, edges: DataFrame, kp1: int, kmer_format: bool = False, max_edges: int = MAX_EDGES) -> DataFrame:
    """restore() for graphs of any size: each group of sequences is decoded with its own edges(grp, code, branch), of group_edges.

    Nothing passes the driver and nothing is broadcast; a task holds one group's
    edges and records, and a group of over ``max_edges`` edges raises.  Where a
    k-mer goes on in one way in the group and in several in the whole graph, the
    mark says that the records have an item for it.  brcs is walk's of the same
    seqs, with grp, with whatever branch set group_edges was given.
    """
    k = kp1 - 1
    rows, carried = _to_decode(brcs, "grp")

    def run(records: pa.Table, edges: pa.Table) -> pa.Table:
        if edges.num_rows > max_edges:
            raise ValueError(f"a group has {edges.num_rows} edges; at most {max_edges} are decoded together")
        codes = np.sort(edges.column("code").to_numpy())
        nodes, at = np.unique(codes >> 2 & (1 << 2 * k) - 1, return_inverse=True)
        masks = np.zeros(len(nodes), np.uint8)
        np.bitwise_or.at(masks, at, np.uint8(1) << (codes & 3).astype(np.uint8))
        own = np.sort(edges.column("code").to_numpy()[edges.column("branch").to_numpy()])
        return _decode(records, k, Sorted(nodes, masks), Sorted(own), kmer_format)

    pieces = rows.groupBy("grp").cogroup(edges.select("grp", "code", "branch").groupBy("grp")).applyInArrow(run, _pieces(rows))
    return _sequences(pieces, carried)


def _name(brcs: DataFrame) -> Column:
    return F.coalesce(F.col("name") if "name" in brcs.columns else F.col("seq_id").cast("string"), F.lit(""))


def to_text(brcs: DataFrame) -> DataFrame:
    """brcs with, in place of brc, record: the text headed by >brc_id|len|start|type|name; the name is seq_id where there is none."""
    head = F.concat_ws("|", F.concat(F.lit(">"), F.col("brc_id")), "len", "start", "type", _name(brcs))
    return brcs.withColumn("record", F.concat(head, F.lit("\n"), "brc", F.lit("\n"))).drop("brc")


def from_text(records: DataFrame) -> DataFrame:
    """records(record, ...) with, in place of record, walk's columns and the name; the name keeps any further bars."""
    head = F.split(F.get("_lines", F.lit(0)), r"\|", 5)
    f = lambda i, t: F.get(head, F.lit(i)).cast(t)
    lines = records.withColumn("_lines", F.split(F.expr("substring(record, 2)"), "\n", 2))
    fields = {"brc_id": f(0, "long"), "len": f(1, "long"), "start": f(2, "long"), "type": f(3, "string"), "name": f(4, "string"), "brc": F.coalesce(F.rtrim(F.get("_lines", F.lit(1)), F.lit("\n")), F.lit(""))}
    return lines.withColumns(fields).drop("record", "_lines")


def write_text(brcs: DataFrame, path: str, order: list[str]) -> None:
    """walk's records as .brc text, in the order of the sequences and of their records; a blank line ends each, so no record's text may hold a line's end."""
    line_end = F.raise_error(F.concat(F.lit("a line's end in a record of "), _name(brcs)))
    checked = brcs.withColumn("brc", F.when(F.col("brc").contains("\n") | _name(brcs).contains("\n"), line_end).otherwise(F.col("brc")))
    to_text(checked.orderBy(*order, "row", "brc_id")).select(F.col("record").alias("value")).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, at, row, name, brc_id, len, start, type, brc) of .brc text files.

    A record is a header line and a line of text, whatever that begins with; files
    are split where a blank line comes before a header, and lines are taken in
    pairs.  A sequence begins where brc_id is 0, so names may be repeated; row
    numbers the sequences, by how many begin up to the record in its split and in
    the splits before it, of which there is a row each.
    """
    raw = spark.read.option("lineSep", "\n\n>").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")]
    pairs = F.regexp_extract_all(F.regexp_replace("value", r"^\s*>", ""), F.lit(r"([^\n]+)(?:\n([^\n]*))?\n*"), F.lit(0))
    each = raw.select(*place, F.explode(pairs).alias("record")).withColumn("at", F.monotonically_increasing_id())
    rows = from_text(each.withColumn("record", F.concat(F.lit(">"), F.regexp_replace("record", "^>(?=[0-9]+[|][0-9]+[|][0-9]+[|])", ""))))
    begins = (F.col("brc_id") == 0).cast("int")
    inside = rows.withColumn("_begun", F.sum(begins).over(W.partitionBy("file", "part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = W.orderBy("file", "part").rowsBetween(W.unboundedPreceding, -1)
    splits = rows.groupBy("file", "part").agg(F.sum(begins).alias("_n")).select("file", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return inside.join(splits, ["file", "part"]).select("file", "part", "at", (F.col("_before") + F.col("_begun")).cast("long").alias("row"), "name", "brc_id", "len", "start", "type", "brc")
