"""SimHash components and sharding against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kmerspark.llm import simhash
from kmerspark.llm.components import components
from kmerspark.llm.sharding import difference, shard_documents
from kmerspark.rows import meet
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \n", "one", "A b", "a B c d", "é É   x y", *(" ".join(rng.choices(["a", "B", "ccc", "dé"], k=n)) for n in (3, 4, 5, 50, 40_000))]:
        assert simhash.fingerprint(text) == brute.simhash(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 5))
def test_forest_finds_all(values, radius):
    fps = np.array(values, dtype=np.uint64)
    tree = np.sort(np.arange(len(fps)) % 3)
    forest = simhash.Forest(fps, tree)
    got = {(int(a), int(b)) for q, n in forest.links(fps, tree, radius) for a, b in zip(q, n, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if tree[i] == tree[j] and (values[i] ^ values[j]).bit_count() <= radius}


def test_block_plan_covers_pairs():
    rng = random.Random(2)
    for n in (10, 10**6, 10**9):
        plan = simhash.block_plan(n)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(all(x >> s & (1 << w) - 1 == y >> s & (1 << w) - 1 for s, w in fields) for fields in plan)


def near(rng, x, flips):
    for b in rng.sample(range(64), flips):
        x ^= 1 << b
    return x


def test_links_and_trees(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:40]:
        y = x
        for _ in range(rng.randint(1, 5)):
            y = near(rng, y, rng.randint(1, 5))
            fps.add(y)
    dense = rng.getrandbits(64)
    fps |= {near(rng, dense, rng.randint(0, 3)) for _ in range(300)}
    fps = list(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute.groups(signed, fps)
    for max_tree in (20_000, 7):
        got = {r.node: r.root for r in components(simhash.links_within(df, max_tree=max_tree)).collect()}
        assert got == {k: v for k, v in want.items() if k != v or sum(x == v for x in want.values()) > 1}


def test_dense_clusters(spark, monkeypatch):
    """Fingerprints over few bits, two clusters and strays around them, in many small trees and slices."""
    monkeypatch.setattr(simhash, "QUERIES", 50)
    rng = random.Random(6)
    one, two = rng.getrandbits(64), rng.getrandbits(64)
    fps = {one ^ rng.getrandbits(10) for _ in range(700)} | {two ^ (rng.getrandbits(8) << 50) for _ in range(150)}
    fps |= {near(rng, one, rng.randint(3, 7)) for _ in range(60)} | {near(rng, two, rng.randint(3, 7)) for _ in range(60)}
    fps = list(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute.groups(signed, fps)
    got = {r.node: r.root for r in components(simhash.links_within(spark.createDataFrame([(x,) for x in signed], "fp long"), max_tree=40)).collect()}
    assert got == {k: v for k, v in want.items() if k != v or sum(x == v for x in want.values()) > 1}


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + 7 * i % 50) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9001, None, ""), (9002, "", ""), (9003, "just one", ""), (9003, "just one", ""), (None, "just one", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(str, (tuple(r) for r in simhash.near_duplicates(df).collect())))
    known = [(i, brute.simhash(t)) for i, t, _ in rows if i is not None]
    want = brute.groups([i for i, _ in known], [f for _, f in known])
    assert got == sorted([str((i, f"{f:016x}", want[i])) for i, f in known] + [str((None, f"{brute.simhash('just one'):016x}", 9003))])
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_one_row_of_each_component_is_kept(spark):
    a, b = "one two three four five six", "other words that are not near at all"
    rows = [(7, a), (7, b), (7, a), (None, a), (None, "a text of its own without an id"), (None, "a text of its own without an id"), (3, b), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, fp long, _row string, root long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(7, a), (3, b), (None, "a text of its own without an id"), (8, None)]))
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_hot_keys_meet_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i % 7 if i < 900 else i, i) for i in range(1000)], "k long, x long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.col("k") * 2)
    for hot in (0, 100, 5000):
        got = sorted((r.k, r.x, r.y) for r in meet(rows, table, ["k"], "n", hot).collect())
        assert got == sorted((r.k, r.x, 2 * r.k) for r in rows.collect())


def test_rest_of_bits():
    for plan in (simhash.block_plan(10), simhash.block_plan(10**9)):
        for fields in plan:
            parts = simhash.rest_of(fields, 5)
            bits = [b for p in [fields, *parts] for s, w in p for b in range(s, s + w)]
            assert len(parts) == 5 and sorted(bits) == list(range(64))


def plain_differencing(sizes, shards):
    """Sums of the shards by the method's own words: partitions as lists, the largest spread first."""
    parts = [[s] + [0] * (shards - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(parts.pop()), sorted(parts.pop(), reverse=True)
        parts.append([x + y for x, y in zip(a, b, strict=True)])
    return parts[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=40, unique=True), st.integers(2, 8))
def test_differencing_against_a_plain_version(sizes, shards):
    at = difference(sizes, shards)
    sums = [sum(s for s, x in zip(sizes, at, strict=True) if x == k) for k in range(shards)]
    plain = plain_differencing(sizes, shards)
    assert max(sums) - min(sums) <= max(max(plain) - min(plain), max(sizes) // 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 8))
def test_differencing_is_balanced(sizes, shards):
    at = difference(sizes, shards)
    sums = [sum(s for s, x in zip(sizes, at, strict=True) if x == k) for k in range(shards)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= max(sizes, default=0)


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400), "") for i in range(3000)] + [(i, "copy é" * 50, "") for i in range(3000, 3150)] + [(4000, None, ""), (4000, None, ""), (None, "n", "")]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, size string")).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, sizes, of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        of[r.size, r.text_crc32].add(r.shard)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values())
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
