"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands, odd sketches, and full sets.

A text's samples are the minima of its shingles' hashes under SAMPLES linear maps.
Bands of a few samples are keys, and documents that share one are candidates; of
two at the least similarity one pair in 10**10 shares none.  All samples are folded
into an odd sketch, a bitmap in which each flips a bit: bits in which two sketches
differ come in pairs from samples that differ, so a count over ``most_odd`` rules
a candidate out, and what is left is compared by the full sets.

Texts of equal sets are one class and compared once.  A key never makes all its
pairs.  First each member meets a pivot alone, the nearest of its keys' pivots, and
what is linked becomes one component; pivots are of the component that comes first
in all keys that share it, so a group of copies falls together in a round or two,
and there are rounds for as long as they settle much.  Then members of different
components of a key are compared by their sketches, and only pairs that pass by
their sets: pair by pair in small keys, in tiles of bounded size in large ones,
from which a spanning forest of the links comes back.

Shingles are compared by 64-bit hashes of their words' hashes.

Defined results: null texts and texts without words have empty sets, and are
linked with nothing; repeated rows are returned repeated, and a null doc_id is
never the smallest, and is not kept; component_id is null where no other id is
reachable; an empty table gives an empty table; columns besides doc_id and text are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.llm.components import components
from kmerspark.rows import MAX_BROADCAST, meet
from kmerspark.scratch import materialize

SHINGLE, PERCENT = 3, 85
#: Samples; bands, and samples of one; bits of a sketch.
SAMPLES, BANDS, IN_BAND, BITS = 256, 32, 4, 2048
#: How often a pair at the least similarity may fail by its sketch.
MISSED = 1e-7
#: Words whose hashes a task remembers, and shingles that are mapped at once.
KNOWN, BLOCK = 1 << 19, 256
#: Rounds of pivots at most; the part of the open pairs that a round may leave for another; and jumps to a component's first member.
ROUNDS, SLOW, JUMPS = 8, 0.8, 2
#: Members of a key that is compared pair by pair; rows and shingles of a tile of one with more.
SMALL, TILE = 8, (2048, 1 << 20)
_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.random.default_rng(20).integers(0, 1 << 63, 3 * SAMPLES + 8, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MAP, _ADD, _FOLD = _ODD[:SAMPLES], _ODD[SAMPLES : 2 * SAMPLES], _ODD[2 * SAMPLES : 3 * SAMPLES]
_PLACE = _ODD[3 * SAMPLES :]


def most_odd(percent: int = PERCENT, samples: int = SAMPLES, missed: float = MISSED) -> int:
    """Bits that two sketches differ in at most, but for a chance of ``missed``, at so many percent of similarity: two for each sample that differs."""
    q, tail, d = 1 - percent / 100, 1.0, -1
    while tail > missed:
        d += 1
        tail -= comb(samples, d) * q**d * (1 - q) ** (samples - d)
    return 2 * d


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _PLACE[4]
    x = (x ^ x >> np.uint64(29)) * _PLACE[5]
    return x ^ x >> np.uint64(32)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or b"").translate(_LOW).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, _PLACE[(0, 6, 7, 3)[n]])
    for i in range(n):
        out += h[i : len(words) - n + 1 + i] * _PLACE[i]
    return np.unique(_mixed(out))


def samples_of(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set's hashes under each linear map."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[a : a + BLOCK, None] * _MAP + _ADD).min(axis=0), out=least)
    return least


def bands_and_sketches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the words of the odd sketch, of rows of samples."""
    n = len(samples)
    own = samples[:, : BANDS * IN_BAND].reshape(n, BANDS, IN_BAND)
    keys = _mixed((own * _FOLD[:IN_BAND]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[7])
    place = (_mixed(samples * _PLACE[2] + _FOLD) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * BITS + place).ravel(), minlength=n * BITS).astype(np.uint8) & 1
    return keys.view(np.int64), np.packbits(flips.reshape(n, BITS), axis=1, bitorder="little").view("<i8")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def sketched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, n, same, keys, sketch), written: the size of each text's set, a digest of it, its bands and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                sets = [shingle_set(t.as_py(), known) for t in b.column(0)]
                keys, sketch = bands_and_sketches(np.stack([samples_of(s) for s in sets]))
                same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), _lists(keys), _lists(sketch)]
                yield pa.RecordBatch.from_arrays(columns, ["text", "doc_id", "n", "same", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("text").cast("binary").alias("text"), "doc_id").mapInArrow(run, f"text binary, doc_id {kind}, n long, same binary, keys array<long>, sketch array<long>")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sketched", "zstd")


def full_sets(rows: DataFrame) -> DataFrame:
    """(row, shingles) of rows(text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                sets = [shingle_set(t.as_py(), known).view(np.int64) for t in b.column(0)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["row", "shingles"])

    return rows.select("text", "row").mapInArrow(run, "row long, shingles array<long>")


def _differ(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def _may_link(percent: int) -> Column:
    """What sizes (n, m) and sketches (sketch, other) allow."""
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (_differ("sketch", "other") <= most_odd(percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, n, m, ...) whose full sets are similar enough; a row of sets moves once for each pair of a, and b may be in many."""
    first = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("own")), "a")
    both = first.join(sets.select(F.col("row").alias("b"), "shingles"), "b")
    common = F.size(F.array_intersect("own", "shingles"))
    return both.where(100 * common >= percent * (F.col("n") + F.col("m") - common)).drop("own", "shingles")


def _rank(turn: int, name: str) -> Column:
    """The order of components in a round; links lead from later ones to earlier ones, so in no circle."""
    return F.struct(F.xxhash64(F.lit(turn), name), name)


def _joined_up(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """members(key, row, comp) with the components that found(x, y) links put together, as far as some jumps go; without keys that hold one component only."""
    up = found.groupBy(F.col("x").alias("comp")).agg(F.min(_rank(turn, "y")).alias("y")).select("comp", F.col("y.y").alias("up"))
    for _ in range(JUMPS):
        up = materialize(up, "hooks")
        up = up.join(up.select(F.col("comp").alias("up"), F.col("up").alias("further")), "up", "left").select("comp", F.coalesce("further", "up").alias("up"))
    now = materialize(members.join(up, "comp", "left").select("key", "row", F.coalesce("up", "comp").alias("comp")), "members")
    several = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return materialize(now.join(several, "key", "left_semi"), "members")


def _open_pairs(members: DataFrame) -> int:
    """Pairs of members of different components, over all keys."""
    comps = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    keys = comps.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")).alias("own"))
    return int(keys.agg(F.sum(F.col("m").cast("decimal(38,0)") * F.col("m") - F.col("own"))).first()[0] or 0) // 2


def similar(classes: DataFrame, rows: DataFrame, percent: int = PERCENT, small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) that connect whatever is similar among classes(row, n, keys, sketch); rows(row, text) has their texts."""
    dealt = classes.select("row", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = materialize(dealt.join(shared, "key").withColumn("comp", F.col("row")), "members")
    wanted = materialize(members.select("row").distinct(), "candidates")
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    only = F.broadcast(wanted) if few else wanted
    sketches = materialize(classes.select("row", "n", "sketch").join(only, "row", "left_semi"), "sketches")
    sets = materialize(full_sets(rows.select("row", "text").join(only, "row", "left_semi")), "shingle-sets")
    other = sketches.select(F.col("row").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    links, before = [], _open_pairs(members)
    for turn in range(rounds):
        # the pivot of a key is of its first component; a member asks the nearest of its pivots
        pivots = members.groupBy("key").agg(F.min(F.struct(_rank(turn, "comp"), F.xxhash64(F.lit(turn), "row"), F.col("row").alias("b"), F.col("comp").alias("y"))).alias("p")).select("key", "p.b", "p.y")
        met = members.join(pivots, "key").where("comp <> y").select(F.col("row").alias("a"), F.col("comp").alias("x"), "b", "y").distinct()
        tried = met.join(sketches.withColumnRenamed("row", "a"), "a").join(other, "b").where(_may_link(percent)).withColumn("odd", _differ("sketch", "other"))
        nearest = tried.groupBy("a").agg(F.min(F.struct("odd", "b", "x", "y", "n", "m")).alias("p")).select("a", "p.b", "p.x", "p.y", "p.n", "p.m")
        found = materialize(_confirmed(nearest, sets, percent), "links")
        links.append(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        members = _joined_up(members, found.select("x", "y"), turn)
        left = _open_pairs(members)
        if left > SLOW * before or not left:
            break
        before = left
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    own = members.join(sizes.where(F.col("c") <= small).select("key"), "key").join(sketches, "row")
    a, b = own.select("key", F.col("row").alias("a"), F.col("comp").alias("x"), "n", "sketch"), own.select("key", F.col("row").alias("b"), F.col("comp").alias("y"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & _may_link(percent)).select("a", "b", "n", "m").distinct()
    links.append(materialize(_confirmed(met, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
    return reduce(DataFrame.unionByName, links, _crowded(members, sizes.where(F.col("c") > small).select("key"), sketches, sets, percent))


def _crowded(members: DataFrame, keys: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect the similar members of different components of each of the keys, in tiles.

    The members of a key are dealt to blocks, so many that one has no more rows and
    shingles than TILE says on average, and each pair of blocks is compared by
    itself.  A tile's links are reduced to a spanning forest, so no more leave it
    than it has rows.
    """
    own = members.join(keys, "key").join(sketches, "row")
    blocks = own.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE[0], F.sum("n") / TILE[1])).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = own.join(blocks, "key").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "row", "comp", "n", "sketch").join(sets, "row")
    spread = placed.select("key", "i", "j", "block", "row", "comp", "n", "sketch", "shingles").repartition("key", "i", "j")
    most = most_odd(percent)
    return materialize(spread.groupBy("key", "i", "j").applyInArrow(lambda t: _tile(t, percent, most), "u long, v long"), "links")


def _tile(t: pa.Table, percent: int, most: int) -> pa.Table:
    """Links of the rows of one block with those of the other, or of one block among themselves."""
    block, row, comp, n = (t.column(c).to_numpy() for c in ("block", "row", "comp", "n"))
    sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(row), -1)
    lists = t.column("shingles").combine_chunks()
    number = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    end = np.cumsum(n)
    _, root = np.unique(comp, return_inverse=True)
    apart, u, v = block.min() != block.max(), [], []
    asking = np.flatnonzero(block == block.min()) if apart else np.arange(len(row))
    mark = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    for a in asking:
        near = np.flatnonzero((block != block[a]) if apart else np.arange(len(row)) > a)
        near = near[(root[near] != root[a]) & (100 * np.minimum(n[near], n[a]) >= percent * np.maximum(n[near], n[a]))]
        near = near[np.bitwise_count(sketch[near] ^ sketch[a]).sum(axis=1) <= most]
        if not len(near):
            continue
        mine = number[end[a] - n[a] : end[a]]
        mark[mine] = True
        for b in near:
            if root[b] != root[a]:
                common = int(mark[number[end[b] - n[b] : end[b]]].sum())
                if 100 * common >= percent * (n[a] + n[b] - common):
                    u.append(row[a])
                    v.append(row[b])
                    root[root == root[b]] = root[a]
        mark[mine] = False
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_duplicates(docs: DataFrame, percent: int = PERCENT, **kw) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (its own id is that)."""
    rows = sketched(docs)
    some = rows.where("n > 0")
    first = materialize(some.groupBy("n", "same").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    classes = materialize(some.select("row", "n", "keys", "sketch").join(first.select("row"), "row"), "sketched-classes")
    groups = components(similar(classes, rows, percent, **kw)).select(F.col("node").alias("row"), "root")
    rooted = first.join(groups, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("n", "same", "copies", "component_id"), "components")
    own = meet(some.select("doc_id", "n", "same"), found, ["n", "same"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
#: The same in SQL, by an inverted index of shingles.
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""
