"""Decoding from the graph alone, against the text and against plain versions."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from kmerspark.functions import codec
from kmerspark.operators import brc, chains, graph, sets
from kmerspark.operators.windows import kmer_codes
from kmerspark import scratch


def letters(rng, n, period=None):
    unit = "".join(rng.choices("ACGT", k=period or n))
    return (unit * (n // len(unit) + 1))[:n] if unit else ""


def texts(rng):
    """Repeats, circles, shared passages, specials, odd rows."""
    shared = letters(rng, 60)
    rows = [letters(rng, rng.randint(0, 40)) for _ in range(12)] + ["A" * 30, "ACAC" * 9, letters(rng, 50, 7), letters(rng, 50, 13)]
    rows += [letters(rng, 10) + shared[: rng.randint(5, 60)] + letters(rng, 10) for _ in range(6)] + [shared, shared + "N" + shared[20:], "NNN", "", None, "ACG>TTN" * 9]
    return [(i % 20, x) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("kp1", "kmer_format", "most", "items"), [(6, True, 5, 2), (9, False, 4096, 4)])
def test_text_comes_back(spark, kp1, kmer_format, most, items):
    rows = texts(random.Random(kp1))
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "seq_id long, seq string, node string")
    edges = kmer_codes(df, kp1).select("code")
    both = sets.merge([graph.multi_out(edges, distinct=True), graph.multi_in(edges, kp1, distinct=True)], distinct=True)
    want = sorted((i, (s or "").upper()) for i, s in rows)
    for branches, own in ((graph.multi_out(edges, distinct=True), None), (both, both)):
        records = brc.walk(df, branches, kp1, kmer_format=kmer_format)
        back = chains.restore_chains(records, edges, kp1, kmer_format, own, most, items)
        assert {*back.columns} == {"row", "seq_id", "node", "seq"}
        assert sorted((r.seq_id, r.seq) for r in back.collect()) == want
    assert chains.restore_chains(records.where("false"), edges, kp1, kmer_format).count() == 0


def test_segments_of_a_long_way(spark):
    """One way of many nodes is cut in pieces; a circle without a head is left out."""
    n = 5000
    way = [(i, "ACGT"[i % 4], i + 1) for i in range(n)] + [(10**6 + i, "A", 10**6 + (i + 1) % 9) for i in range(9)]
    plain = spark.createDataFrame(way, "node long, base string, end long")
    heads = spark.createDataFrame([(0,), (3000,)], "node long")
    got = sorted(tuple(r) for r in chains.segments(plain, heads, 1024).collect())
    starts = [0, 1024, 2048, 3000, 3000 + 1024, n]
    assert got == [(a, "".join("ACGT"[i % 4] for i in range(a, b)), b) for a, b in zip(starts, starts[1:], strict=False)]


def test_steps_of_a_node_exclude_each_other(spark):
    df = spark.createDataFrame([(1, letters(random.Random(1), 3000))], "seq_id long, seq string")
    edges = kmer_codes(df, 6).select("code")
    starts = kmer_codes(df, 5).select(F.col("code").alias("node")).distinct()
    table = {r.node: [s.items for s in r.steps] for r in chains.steps(edges, 5, starts).collect()}
    assert max(map(len, table.values())) > 4
    for items in table.values():
        assert len(items) <= chains.FAN and not any(a != b and b.startswith(a) for a in items for b in items)


def test_other_graphs_raise(spark):
    df = spark.createDataFrame([(1, "ACGTTACGATTGACCA" + letters(random.Random(2), 60))], "seq_id long, seq string")
    edges = kmer_codes(df, 5).select("code").distinct()
    records = brc.walk(df, graph.multi_out(edges), 5)
    some = edges.where(F.col("code") != F.lit(records.select(codec.encode(F.substring("brc", 1, 4)).alias("n")).first().n * 4 + 3))
    cut = records.withColumn("brc", F.expr("substring(brc, 1, length(brc) - 3)"))
    with pytest.raises(Exception, match="length is reached|no successor"):
        chains.restore_chains(cut, edges, 5).collect()
    fewer = some.where("code % 3 > 0")
    with pytest.raises(Exception, match="length is reached|no successor"):
        chains.restore_chains(records, fewer, 5).collect()

def test_runs_are_joined_before_pointers(spark):
    """Rows that pointers are doubled over, all rounds together, are fewer than the edges, of which each had one a round."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, letters(rng, 900) + "ACGT"[i] + letters(rng, 300)) for i in range(4)], "seq_id long, seq string")
    edges = kmer_codes(df, 22).select("code")
    base = glob.glob(scratch.shared_dir(spark).removeprefix("file://"))[0]
    old = set(glob.glob(f"{base}/pointers-*"))
    back = chains.restore_chains(brc.walk(df, graph.multi_out(edges, distinct=True), 22), edges, 22)
    assert sorted((r.seq_id, r.seq) for r in back.collect()) == sorted(map(tuple, df.collect()))
    new = [p for p in glob.glob(f"{base}/pointers-*") if p not in old]
    assert len(new) > 2 and sum(spark.read.parquet(p).count() for p in new) < edges.distinct().count()


@pytest.mark.parametrize("rows", [1, 7, 1 << 20])
def test_runs_of_any_rows_stop_before_heads(spark, rows):
    """Runs hold each edge once, and none goes on over a head, wherever the rows are cut."""
    df = spark.createDataFrame([(1, letters(random.Random(4), 700))], "seq_id long, seq string")
    edges = chains._edges(chains._masks(kmer_codes(df, 10).select("code"), None), 9)
    heads = edges.groupBy("end").agg(F.count("*").alias("n"), F.bool_or("item").alias("i")).where("n > 1 OR i").select(F.col("end").alias("node"))
    heads = heads.unionByName(edges.where("code % 17 = 0").select("node")).distinct()
    stops = {r.node for r in heads.collect()}
    found = []
    for r in chains.runs(edges.where("NOT item"), heads, 9, 16, rows).collect():
        node = r.node
        assert 0 < len(r.base) <= 16
        for i, b in enumerate(r.base):
            assert not i or node not in stops
            found.append(node << 2 | "ACGT".index(b))
            node = found[-1] & (1 << 18) - 1
        assert node == r.end
    assert sorted(found) == sorted(r.code for r in edges.where("NOT item").collect())


def test_broadcast_and_shuffled_fronts_agree(spark, monkeypatch):
    rows = texts(random.Random(5))
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "seq_id long, seq string, node string")
    edges = kmer_codes(df, 6).select("code")
    records, got = brc.walk(df, graph.multi_out(edges, distinct=True), 6), []
    for few in (0, 500_000):
        monkeypatch.setattr(chains, "FEW", few)
        got.append(sorted((r.seq_id, r.seq) for r in chains.restore_chains(records, edges, 6).collect()))
    assert got[0] == got[1] == sorted((i, (s or "").upper()) for i, s in rows)


def test_graph_given_as_masks(spark):
    rows = texts(random.Random(6))
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "seq_id long, seq string, node string")
    edges = kmer_codes(df, 7).select("code")
    masks = scratch.materialize(graph.successor_masks(edges), "masks")
    branches = graph.branches_of_masks(masks)
    assert sorted(branches.collect()) == sorted(graph.multi_out(edges, distinct=True).collect())
    back = chains.restore_chains(brc.walk(df, branches, 7), masks, 7)
    assert sorted((r.seq_id, r.seq) for r in back.collect()) == sorted((i, (s or "").upper()) for i, s in rows)
