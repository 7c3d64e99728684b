"""Decoding branch-only records from the graph alone, of any size: nothing is collected, and only counted, bounded tables are broadcast.

A k-mer at which a record has no item to read goes on in one way.  Such k-mers
are put together in segments, from one where ways meet or a record begins to the
next.  K-mers that follow each other mostly share their minimizer, so they are
dealt by it, once, and joined to runs where they meet; a run's place in its
segment is found by doubling pointers to the runs before it, so the rounds grow
with the logarithm of the longest segment, which is then cut into pieces of
bounded length.  What is left is a table of steps: from a
node, for each string of items that may be read there, the bases that follow and
the node that they lead to.  Steps are composed with those that follow, within
bounds of items and bases, so that one covers several.

A record is a row of a frontier: its node, the items and the bases that are
left.  In each round the frontier meets the steps in a join, writes the bases that
its items choose, and moves on; rounds go on for as long as the record with most
items has some left.  Once few records, or few pointers, are left, they are
broadcast, and the table that they meet is read where it lies.

Defined results: those of brc.py.  Edges that are not those of the encoded
sequences raise, where a record has no way on or too few items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.functions import codec
from kmerspark.operators import brc
from kmerspark.operators.flat import strings
from kmerspark.operators.graph import successor_masks
from kmerspark.scratch import materialize, scratch_path

#: Bases of a step; items of a step, rounds of composing, and steps that one node keeps at most.
STEP_BASES, STEP_ITEMS, COMPOSED, FAN = 4096, 4, 2, 64
#: Bases of a minimizer, rows that are joined to runs together, and bases of a run at most.
MINIMIZER, JOINED, RUN = 8, 1 << 20, 256
#: Records or pointers, and bytes of their items, that are broadcast at most.
FEW, FEW_ITEMS = 500_000, 1 << 25
_NO_WAY = "no successor: the edges are not those of the encoded sequence"
_STEP = "struct<items: string, bases: string, at: array<int>, end: bigint>"


def _base(code: Column) -> Column:
    return F.substring(F.lit(codec.BASES), code.cast("int") + 1, F.lit(1))


def _masks(edges: DataFrame, branch_set: DataFrame | None) -> DataFrame:
    """(node, mask, also), written unless edges are given as masks: the bases that a k-mer goes on with, and those of them whose edges are in the branch set, as bits."""
    masks, also = successor_masks(edges), F.lit(0)
    if branch_set is not None:
        masks = masks.join(successor_masks(branch_set).withColumnRenamed("mask", "also"), "kmer", "left")
        also = F.coalesce("also", also)
    rows = masks.select(F.col("kmer").alias("node"), F.col("mask").cast("byte"), also.cast("byte").alias("also"))
    return rows if "mask" in edges.columns and branch_set is None else materialize(rows, "edges", "zstd")


def _edges(masks: DataFrame, k: int) -> DataFrame:
    """(node, code, end, item): each edge once, and whether a record has an item for it."""
    bit = lambda b: F.call_function("shiftleft", F.lit(1), b)
    bases = F.filter(F.array(*map(F.lit, range(4))), lambda b: F.col("mask").cast("int").bitwiseAND(bit(b)) != 0)
    each = masks.select("node", "mask", "also", F.explode(bases).alias("base"))
    item = (F.bit_count("mask") > 1) | (F.col("also").cast("int").bitwiseAND(bit(F.col("base"))) != 0)
    code = F.shiftleft("node", 2).bitwiseOR(F.col("base").cast("long")).alias("code")
    return each.select("node", code, item.alias("item")).select("node", "code", codec.suffix("code", k).alias("end"), "item")


def _node(code: np.ndarray, k: int) -> np.ndarray:
    return code >> 2 & (1 << 2 * k) - 1


def _minimizer(node: np.ndarray, k: int) -> np.ndarray:
    """The least of the k-mer's parts of MINIMIZER bases, in an order of no meaning."""
    m = min(MINIMIZER, max(1, k // 2))
    least = np.full(len(node), np.iinfo(np.int64).max)
    for i in range(k - m + 1):
        part = node >> 2 * i & (1 << 2 * m) - 1
        least = np.minimum(least, (part + 1) * 0x9E3779B1 & 0x7FFFFFFF)
    return least


def _joined(code: np.ndarray, head: np.ndarray, k: int, most: int) -> pa.RecordBatch:
    """The rows of one table that runs() makes of the codes of some edges, no two of which leave the same k-mer, and of heads and any base."""
    node, plain = _node(code, k), ~head
    heads, order = np.unique(node[head]), np.argsort(node[plain])
    node, base = node[plain][order], code[plain][order] & 3
    end, n = (node << 2 | base) & (1 << 2 * k) - 1, len(node)
    at = np.minimum(np.searchsorted(node, end), max(n - 1, 0))
    goes_on = (node[at] == end) & ~np.isin(end, heads) if n else np.zeros(0, bool)
    before = np.full(n, -1)
    before[at[goes_on]] = np.flatnonzero(goes_on)
    up, far = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
    for _ in range(n.bit_length()):
        further = far + far[up]
        if (further == far).all():
            break
        up, far = up[up], further
    kept = np.flatnonzero(before[up] < 0)  # the others go in a circle
    kept = kept[np.lexsort((far[kept], up[kept]))]
    first = np.flatnonzero(far[kept] % most == 0)
    last = np.append(first[1:], len(kept)) - 1 if len(first) else first
    text = np.frombuffer(codec.BASES.encode(), np.uint8)[base[kept]]
    return pa.RecordBatch.from_arrays([pa.array(node[kept[first]]), strings(text, last - first + 1), pa.array(end[kept[last]])], ["node", "base", "end"])


def runs(plain: DataFrame, heads: DataFrame, k: int, most: int = RUN, rows: int = JOINED) -> DataFrame:
    """(node, base, end): edges plain(code) put together, base being the bases of several, no run going on over one of heads(node).

    plain and heads are as segments() has them.  Runs need not be as long as they
    could be: ``rows`` rows, dealt and sorted by minimizer, are joined at once.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _minimizer(_node(b.column(0).to_numpy(), k), k).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], ["key", "code", "head"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= rows:
                code, head = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero(code[1:] >> 2 != code[:-1] >> 2)
                cut = int(cut[-1]) + 1 if len(cut) else 0  # a k-mer and its mark stay together
                if cut:
                    yield _joined(code[:cut], head[:cut], k, most)
                held, n = [(code[cut:], head[cut:])], n - cut
        if n:
            yield _joined(*(np.concatenate(x) for x in zip(*held, strict=True)), k, most)

    marks = heads.select(F.shiftleft("node", 2).alias("code"), F.lit(True).alias("head"))
    both = plain.select("code", F.lit(False).alias("head")).unionByName(marks)
    dealt = both.mapInArrow(keyed, "key int, code long, head boolean").repartition("key").sortWithinPartitions("key", "code")
    return dealt.select("code", "head").mapInArrow(join, "node long, base string, end long")


def segments(plain: DataFrame, heads: DataFrame, most: int = STEP_BASES) -> DataFrame:
    """(node, bases, end): maximal ways of plain(node, base, end), whose nodes go on in one way, cut before heads(node) and after ``most`` bases.

    A node that is no head has one node before it.  Ways in a circle that no head
    lies on are left out, as no record comes to them.  base may be of several
    bases, and the row that reaches ``most`` is not cut.  plain is read more than
    once: give a written table.
    """
    is_head = heads.select("node").distinct().withColumn("head", F.lit(True))
    before = plain.select(F.col("end").alias("node"), F.col("node").alias("up"), F.length("base").cast("long").alias("far"))
    before = before.groupBy("node").agg(F.min("up").alias("up"), F.min("far").alias("far"))  # only heads have several, which are not asked
    own = F.col("head").isNotNull() | F.col("up").isNull()
    first = plain.select("node").join(is_head, "node", "left").join(before, "node", "left").select("node", F.when(own, F.col("node")).otherwise(F.col("up")).alias("up"), F.when(own, 0).otherwise(F.col("far")).alias("far"))
    now = materialize(first, "pointers", "zstd")
    done, on, waiting = now.where("far = 0").select("node", "up", "far"), now.where("far > 0"), None
    while True:  # a pointer has come to its end when it is at a head, which points at itself
        left = on.count()
        if left in (0, waiting):
            break
        there = done.unionByName(on).select(F.col("node").alias("up"), F.col("up").alias("upper"), F.col("far").alias("further"))
        moved = (F.broadcast(on) if left <= FEW else on).join(there, "up").select("node", F.col("upper").alias("up"), (F.col("far") + F.col("further")).alias("far"), (F.col("further") > 0).alias("on"))
        now, waiting = materialize(moved, "pointers", "zstd"), left
        done, on = done.unionByName(now.where("NOT on").drop("on")), now.where("on").drop("on")
    whole = plain.join(done, "node").groupBy("up", F.floor(F.col("far") / most).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("far", "node", "base", "end"))).alias("way"))
    return whole.select(F.get("way", F.lit(0))["node"].alias("node"), F.array_join(F.transform("way", lambda x: x["base"]), "").alias("bases"), F.element_at("way", -1)["end"].alias("end"))


def steps(edges: DataFrame, k: int, starts: DataFrame, branch_set: DataFrame | None = None, most: int = STEP_BASES, items: int = STEP_ITEMS, rounds: int = COMPOSED) -> DataFrame:
    """(node, steps), written: for each node that a record may stand at between two steps, those that go on from it.

    The strings of items of a node's steps are no prefixes of each other, and one
    of them fits whatever a record reads there.  at: where in bases the items are.
    """
    each = _edges(_masks(edges, branch_set), k)
    entries = each.groupBy(F.col("end").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("item").alias("item"))
    heads = entries.where((F.col("n") > 1) | F.col("item")).select("node").unionByName(starts.select("node"))
    heads = materialize(heads.distinct(), "heads", "zstd")
    plain = materialize(runs(each.where("NOT item"), heads, k, min(RUN, most)), "runs", "zstd")
    read = each.where("item").select("node", _base(codec.last_base("code")).alias("base"), "end")
    ways = segments(plain, heads, most).select("node", F.lit("").alias("items"), "bases", F.array().cast("array<int>").alias("at"), "end")
    all_ = ways.unionByName(read.select("node", F.col("base").alias("items"), F.col("base").alias("bases"), F.array(F.lit(0)).alias("at"), "end"))
    now = materialize(_by_node(all_), "steps", "zstd")
    for _ in range(rounds):
        now = materialize(_composed(now, most, items), "steps", "zstd")
    return now


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.collect_list(F.struct("items", "bases", "at", "end").cast(_STEP)).alias("steps"))


def _composed(table: DataFrame, most: int, items: int) -> DataFrame:
    """Each step followed by each of those at its end, where all of them stay within the bounds."""
    longest = lambda what: F.aggregate("steps", F.lit(0), lambda m, x: F.greatest(m, F.length(x[what])))
    next_ = table.select(F.col("node").alias("end"), F.col("steps").alias("then"), longest("items").alias("more_items"), longest("bases").alias("more_bases"))
    one = table.select("node", F.size("steps").alias("fan"), F.explode("steps").alias("s")).select("node", "fan", "s", F.col("s.end").alias("end")).join(next_, "end", "left")
    fits = F.col("then").isNotNull() & (F.length("s.items") + F.col("more_items") <= items) & (F.length("s.bases") + F.col("more_bases") <= most) & (F.col("fan") * F.size("then") <= FAN)
    s = F.col("s")
    long = F.transform("then", lambda t: F.struct(F.concat(s["items"], t["items"]).alias("items"), F.concat(s["bases"], t["bases"]).alias("bases"), F.concat(s["at"], F.transform(t["at"], lambda i: i + F.length(s["bases"]))).alias("at"), t["end"].alias("end")))
    return _by_node(one.select("node", F.explode(F.when(fits, long.cast(f"array<{_STEP}>")).otherwise(F.array(s.cast(_STEP)))).alias("s")).select("node", "s.*"))


def restore_chains(brcs: DataFrame, edges: DataFrame, kp1: int, kmer_format: bool = False, branch_set: DataFrame | None = None, most: int = STEP_BASES, items: int = STEP_ITEMS) -> DataFrame:
    """The sequences (seq, and the columns that walk carried along) from walk's records and the graph's edges(code), as brc.restore gives them.

    edges may be given as a written table of graph.successor_masks(), which is not shuffled again.

    Runs when this is called, in about (items of the longest record) / (items of a step) rounds.
    """
    k = kp1 - 1
    rows, carried = brc._to_decode(brcs)
    rows = materialize(rows.withColumn("record", F.monotonically_increasing_id()), "records", "zstd")
    good = rows.where("type = 'good'")
    text = F.substring("brc", F.lit(k + 1), F.length("brc"))
    last = F.regexp_replace(text, f".{{{k}}}(.)", "$1") if kmer_format else text
    begun = good.select("record", codec.encode(F.substring("brc", F.lit(1), F.lit(k))).alias("node"), (F.col("len") - k).alias("left"), last.alias("items"), F.substring("brc", F.lit(1), F.lit(k)).alias("piece"))
    table = steps(edges, k, begun.select("node").distinct(), branch_set, most, items)
    spark, base, turn = brcs.sparkSession, scratch_path(brcs.sparkSession, "pieces"), 0
    begun.write.option("compression", "zstd").parquet(f"{base}/turn=0")
    kind = "record long, piece string, node long, left long, items string"
    read = lambda: spark.read.schema(kind).parquet(f"{base}/turn={turn}")
    while True:
        front = read().where("left > 0").drop("piece")
        size = front.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("items")).alias("items")).first()
        if not size.n:
            break
        turn += 1
        few = size.n <= FEW and size.items <= FEW_ITEMS
        _round(F.broadcast(front) if few else front, table).write.option("compression", "zstd").parquet(f"{base}/turn={turn}")
        if read().count() != size.n:
            raise ValueError(_NO_WAY)
    written = spark.read.schema("record long, piece string, turn int").parquet(base)
    texts = written.groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("text"))
    whole = rows.join(texts, "record", "left").select("row", "brc_id", F.when(F.col("type") == "good", F.col("text")).otherwise(F.col("brc")).alias("piece"), "carried")
    return brc._sequences(whole, carried)


def _round(front: DataFrame, table: DataFrame) -> DataFrame:
    """(record, piece, node, left, items): each record one step further; one at whose node no step begins is not there."""
    met = front.join(table, "node")
    fits = F.filter("steps", lambda s: F.startswith(F.col("items"), s["items"]) | F.startswith(s["items"], F.col("items")))
    s = F.get(fits, F.lit(0))
    met = met.withColumn("s", F.when(F.size(fits) == 0, F.raise_error(F.lit(_NO_WAY)).cast(_STEP)).otherwise(s))
    read = F.length("items")
    # bases up to the first item that the record does not have
    known = F.least(F.col("left"), F.coalesce(F.get(F.col("s.at"), read), F.length("s.bases")).cast("long"))
    ends = F.raise_error(F.lit("a record ends before its length is reached")).cast("long")
    know = F.when((known < F.col("left")) & F.get(F.col("s.at"), read).isNotNull(), ends).otherwise(known)
    met = met.withColumn("know", know)
    return met.select("record", F.substring("s.bases", F.lit(1), F.col("know").cast("int")).alias("piece"), F.col("s.end").alias("node"), (F.col("left") - F.col("know")).alias("left"), F.substring("items", F.length("s.items") + 1, read).alias("items"))
