"""SimHash near-duplicates, searched with BK-trees.

A fingerprint is computed from all shingles of a text.  Distinct fingerprints
are dealt to shards so that two within the radius meet in at least one: of n
blocks of bits, at most ``radius`` can differ, so fingerprints that agree on
some choice of n - radius blocks share that shard.  A shard's fingerprints form
a BK-tree, whose edges carry the distance of child and parent; a query follows
only edges within the radius of its own distance.  A large shard is dealt anew
by the bits that its fingerprints need not agree on: cut into radius + 1 parts,
two within the radius agree on one of them.  What is still large after that is
cut into several trees.  Its fingerprints that differ in one bit are linked first,
by what they share without it, and those of the largest group so linked do not ask:
they are a cluster already, and all others are sent to every tree and so find what
links them to it.  A dense cluster is thus not compared with itself.

From a shard only a spanning forest of its links leaves, never all pairs, and
components are joined up across shards by a distributed algorithm.

Defined results: null and empty texts have fingerprint 0, linked like any other;
exact copies share a fingerprint and so a component; a null doc_id is never a
component's smallest, and component_id is null where there is no other; repeated
rows are returned repeated; an empty table gives an empty table; columns besides
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from kmerspark.llm.components import components
from kmerspark.rows import fresh, meet, without_rows
from kmerspark.scratch import materialize

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15
#: Nodes of one BK-tree, fingerprints that a shard should have on average at most, and visits that are held at once.
MAX_TREE = 20_000
MEAN_SHARD = 4_096
VISITS = 1 << 20
#: Queries that one task holds for a tree, on average at most.
QUERIES = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and only ASCII space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "fp", whole: bool = True) -> DataFrame:
    """docs(text, ...) with the fingerprint as a signed long in a further column, and without the text unless whole; the text comes first in docs."""
    own = 0 if whole else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[own:], pa.array(fps)], [*b.schema.names[own:], name])

    return docs.mapInArrow(run, StructType(docs.schema.fields[own:]).add(name, LongType()))


class Forest:
    """BK-trees over groups of distinct fingerprints, built and queried in arrays.

    fps: the nodes, those of one tree next to each other; tree: each node's tree,
    ascending.  The first node of a tree is its root.
    """

    def __init__(self, fps: np.ndarray, tree: np.ndarray):
        self.fps = fps
        new = np.concatenate(([True], tree[1:] != tree[:-1])) if len(tree) else np.zeros(0, bool)
        self.root_of = np.flatnonzero(new)
        self.trees = tree[self.root_of]
        items = np.flatnonzero(~new)
        at = self.root_of[np.cumsum(new) - 1][items]  # where each item stands on its way down
        edges, children = [], []
        while len(items):
            edge = at * 128 + np.bitwise_count(fps[items] ^ fps[at])  # 128: over any distance
            order = np.argsort(edge, kind="stable")
            items, edge = items[order], edge[order]
            first = np.concatenate(([True], edge[1:] != edge[:-1]))
            edges.append(edge[first])
            children.append(items[first])
            at = items[first][np.cumsum(first) - 1][~first]
            items = items[~first]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def links(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius, for queries each put to one tree; in blocks."""
        root = self.root_of[np.searchsorted(self.trees, tree)]
        stack = [(np.arange(a, min(a + 4096, len(queries))), root[a : a + 4096]) for a in range(0, len(queries), 4096)]
        while stack:
            q, node = stack.pop()
            if len(q) > VISITS:  # hold no more visits at once
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.edge, node * 128 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 128 + np.minimum(d + radius, 127), "right")
            n = hi - lo
            if total := int(n.sum()):
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.child[np.repeat(lo, n) + step]))


def spanning(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Merge the components of a[i] and b[i] in root, in place; root[x] is the least member known of x."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # shorten paths
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def block_plan(n: int, radius: int = RADIUS, mean: int = MEAN_SHARD) -> list[list[tuple[int, int]]]:
    """Which (shift, width) bit fields make each shard key, for n fingerprints.

    The fewest blocks that keep shards at ``mean`` fingerprints on average; any
    plan finds every link.
    """
    for same in range(1, 64 - radius):
        blocks = radius + same
        edges = [64 * i // blocks for i in range(blocks + 1)]
        fields = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
        if n <= mean << (64 // blocks * same) or comb(blocks + 1, radius) > 200:
            return [list(c) for c in combinations(fields, same)]
    raise ValueError("radius")


def rest_of(fields: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """The bits outside the fields, in so many parts of (shift, width) fields."""
    held = {b for shift, width in fields for b in range(shift, shift + width)}
    free = [b for b in range(64) if b not in held]
    out = []
    for i in range(parts):
        own: list[tuple[int, int]] = []
        for b in free[len(free) * i // parts : len(free) * (i + 1) // parts]:
            if own and sum(own[-1]) == b:
                own[-1] = (own[-1][0], own[-1][1] + 1)
            else:
                own.append((b, 1))
        out.append(own)
    return out


def links_within(fps: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """Links (u, v) of fps(fp), distinct longs, that connect all within the radius of each other.

    In each shard the links are reduced to a spanning forest.
    """
    plan = block_plan(fps.count(), radius)

    def key(fields: list[tuple[int, int]]):
        out = F.lit(0).cast("long")
        for shift, width in fields:
            out = out * (1 << width) + F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
        return out

    def large(shards: DataFrame, keys: list[str]) -> DataFrame:
        return shards.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_tree).select(*keys, F.ceil(F.col("n") / max_tree).cast("int").alias("trees"))

    dealt = fps.select("fp", F.posexplode(F.array(*[key(f) for f in plan])).alias("part", "key"))
    marked = dealt.join(large(dealt, ["part", "key"]), ["part", "key"], "left")
    again = F.lit(None).cast("array<bigint>")
    for part, fields in enumerate(plan):
        again = F.when(F.col("part") == part, F.array(*[key(f) for f in rest_of(fields, radius + 1)])).otherwise(again)
    anew = marked.select("fp", "part", "key", F.posexplode(F.when(F.col("trees").isNull(), F.array(F.lit(0).cast("long"))).otherwise(again)).alias("sub", "subkey"))
    shard = ["part", "key", "sub", "subkey"]
    sized = anew.join(large(anew, shard), shard, "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    sized, near = materialize(sized, "shards"), None
    dense = sized.where("trees > 1").select("fp").distinct()
    if dense.isEmpty():
        sized = sized.withColumns({"asks": F.lit(True), "slices": F.lit(1)})
    else:
        near = materialize(components(one_bit_links(dense)).where("node <> root"), "one-bit-groups").select(F.col("node").alias("u"), F.col("root").alias("v"))
        sized = _asking(sized, near, shard)
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    in_trees = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("trees") - 1)).otherwise(F.array("own"))
    sent = sized.withColumn("own", own).select("fp", *shard, "own", "asks", "slices", F.explode(in_trees).alias("tree"))
    # a tree's nodes are in each slice of its queries, and a query is in one
    slice_ = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("slices")).cast("int")
    node = F.col("own") == F.col("tree")
    sent = sent.withColumn("of", slice_).withColumn("slice", F.explode(F.when(node, F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("of"))))
    rows = sent.select(*shard, "tree", "slice", node.alias("node"), "fp", (F.col("asks") & (F.col("of") == F.col("slice"))).alias("asks"))
    spread = rows.repartition(*shard, "tree", "slice").sortWithinPartitions(*shard, "tree", "slice", F.desc("node"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cut = _last_group(b)
            if cut:
                held.append(b.slice(0, cut))
                yield from _search(held, radius)
                held = []
            held.append(b.slice(cut))
        yield from _search(held, radius)

    found = spread.mapInArrow(run, "u long, v long")
    return found if near is None else found.unionByName(near)


def one_bit_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) of those of fps(fp) that differ in one bit: they agree on what is left without it."""
    without = fps.select("fp", F.explode(F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])).alias("bit"))
    met = without.groupBy("bit", F.col("fp").bitwiseAND(F.bitwise_not("bit")).alias("rest")).agg(F.min("fp").alias("u"), F.max("fp").alias("v"))
    return met.where("u < v").select("u", "v")


def _asking(sized: DataFrame, groups: DataFrame, shard: list[str]) -> DataFrame:
    """sized(fp, shard, trees) with asks and slices: of a shard of several trees, all ask but the largest of the groups(u, v), where v stands for its group.

    Its members are linked with each other already, and to the others by what
    those ask; so a dense cluster is not compared with itself, and a shard that is
    one group not at all.  slices: how many parts the queries of a shard are dealt to.
    """
    rooted = materialize(sized.where("trees > 1").join(groups.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sizes = rooted.groupBy(*shard, "root").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy(*shard).agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).withColumn("others", F.col("all") - F.col("m.c")).where("others > 0")
    most = most.select(*shard, F.col("m.root").alias("largest"), (1 + F.floor(F.col("others") / QUERIES)).cast("int").alias("slices"))
    asking = rooted.join(most, shard).select("fp", *shard, "trees", (F.col("root") != F.col("largest")).alias("asks"), "slices")
    return sized.where("trees = 1").withColumns({"asks": F.lit(True), "slices": F.lit(1)}).select(*asking.columns).unionByName(asking)


def _last_group(b: pa.RecordBatch) -> int:
    """Where the batch's last shard starts."""
    cols = [np.asarray(b.column(i)) for i in range(6)]
    same = np.logical_and.reduce([c == c[-1] for c in cols]) if b.num_rows else np.zeros(0, bool)
    return b.num_rows - int(same[::-1].argmin()) if b.num_rows and not same.all() else 0


def _search(held: list[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    if not t.num_rows:
        return
    *place, node, asks = (np.asarray(t.column(i).to_numpy()) for i in (*range(7), 8))
    fp = t.column(7).to_numpy().view(np.uint64)
    shard = np.cumsum(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in place])))) - 1
    lone = np.bincount(shard)[shard] < 2
    fp, shard, node, asks = fp[~lone], shard[~lone], node[~lone], asks[~lone]
    if not len(fp):
        return
    nodes = np.flatnonzero(node)
    forest = Forest(fp[nodes], shard[nodes])
    asked = np.flatnonzero(np.isin(shard, forest.trees) & asks)
    root = np.arange(len(fp))
    for q, n in forest.links(fp[asked], shard[asked], radius):
        spanning(asked[q], nodes[n], root)
    out = np.flatnonzero(root != np.arange(len(fp)))
    yield pa.RecordBatch.from_arrays([pa.array(fp[out].view(np.int64)), pa.array(fp[root[out]].view(np.int64))], ["u", "v"])


def _roots(first: DataFrame, radius: int) -> DataFrame:
    """first(fp, ...) with the root of each fp's component."""
    groups = components(links_within(first.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    return first.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint, component_id."""
    prints = materialize(fingerprints(docs.select("text", "doc_id"), whole=False), "fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    rooted = _roots(first, radius)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(rooted.join(smallest, "root").select("fp", "n", "component_id"), "components")
    return meet(prints, found, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, nulls last, then of the least hash of the text.

    Rows are told apart by their numbers, so repeated and null doc_ids are rows
    like others: two texts that are not near each other both stay.
    """
    row, fp = fresh("_row", docs.columns), fresh("_fp", docs.columns)
    others = [c for c in docs.columns if c != "text"]
    tagged = materialize(fingerprints(docs.select("text", *others, F.monotonically_increasing_id().alias(row)), fp), "tagged", "zstd")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row).alias("row"))
    first = materialize(tagged.select(F.col(fp).alias("fp"), rank.alias("rank")).groupBy("fp").agg(F.min("rank").alias("rank")), "distinct-fingerprints")
    kept = _roots(first, radius).groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    dropped = materialize(tagged.select(row).join(kept, row, "left_anti"), "dropped")
    return without_rows(tagged, dropped, row).select(*docs.columns)
