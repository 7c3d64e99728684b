"""Walk and unitig by blocks against the whole rows, and both against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from kmerspark.operators import brc, flat, graph, sets, unitigs
from kmerspark.operators.windows import kmer_codes

ALPHABET = "ACGTacgtACGTN-é\U0001f600>"


def texts(rng):
    rows = ["".join(rng.choices(ALPHABET, [9] * 12 + [1] * 5, k=rng.choice([0, 1, 3, 4, 5, 16, 17, 40, 90]))) for _ in range(60)]
    return [(i % 40 or None, x) for i, x in enumerate([*rows, None, "", "ACGT" * 30, "N" * 40, "ACGT" * 8 + "N" * 20 + "ACGTT" * 9, "ACG", "ACGTACGT"])]


@pytest.mark.parametrize(("kp1", "size"), [(4, 4), (6, 16)])
def test_blocks_are_the_rows(spark, kp1, size):
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in texts(random.Random(size))], "seq_id long, seq string, name string, id long")
    edges = kmer_codes(df, kp1).select("code").distinct()
    o = graph.multi_out(edges)
    both = sets.merge([o, graph.multi_in(edges, kp1)], distinct=True)
    key = lambda df, drop=(): sorted(map(repr, (tuple(r) for r in df.select(*sorted(c for c in df.columns if c not in drop)).collect())))
    for kw in ({}, {"kmer_format": True}, {"pass_special": True, "max_set": 0}):
        assert key(brc.walk_blocks(df, o, kp1, size=size, **kw), ["row"]) == key(brc.walk(df, o, kp1, **kw), ["row"])
    assert key(unitigs.cut_unitigs_blocks(df, both, kp1, size=size)) == key(unitigs.cut_unitigs(df, both, kp1))
    back = brc.restore(brc.walk_blocks(df, o, kp1, size=size), edges, kp1)
    assert key(back.select("seq_id", "seq")) == sorted(map(repr, (("".join(c.upper() if c.isascii() else c for c in s or ""), i) for i, s in texts(random.Random(size)))))
    assert brc.walk_blocks(df.where("false"), o, kp1, size=size).count() == 0 == unitigs.cut_unitigs_blocks(df.where("false"), o, kp1, size=size).count()
    with pytest.raises(ValueError, match="shorter"):
        brc.walk_blocks(df, o, kp1, size=kp1 - 2)


def plain_segments(text, kp1):
    """(start, end, good) one after the other."""
    runs, at = [], 0
    while at < len(text):
        to = at
        while to < len(text) and (text[to] in "ACGTacgt") == (text[at] in "ACGTacgt"):
            to += 1
        runs.append((at, to, text[at] in "ACGTacgt" and to - at >= kp1))
        at = to
    out = []
    for a, b, good in runs:
        if out and not good and not out[-1][2]:
            out[-1] = (out[-1][0], b, False)
        else:
            out.append((a, b, good))
    return out or [(0, 0, False)]


def plain_pieces(text, cuts, kp1):
    out, at = [], 0
    while at < len(text):
        to = at
        while to < len(text) and (text[to] in "ACGTacgt") == (text[at] in "ACGTacgt"):
            to += 1
        own = [c for c in cuts if at <= c < to]
        out += list(zip([at] + [c - kp1 + 2 for c in own], [*own, to], strict=True))
        at = to
    return out or [(0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=6), st.integers(2, 6), st.randoms(use_true_random=False))
def test_kernels(rows, kp1, rng):
    f = flat.Flat(pa.array(rows, pa.string()))
    codes = [c for r in rows for c in flat.base_windows(flat.Flat(pa.array([r], pa.string())).base, kp1)[1].tolist()]
    branches = np.unique(np.array([c for c in codes if rng.random() < 0.4], np.int64))
    f.mark(branches, kp1)
    at = [np.flatnonzero(f.branch[f.begin[i] : f.end[i]]).tolist() for i in range(len(rows))]
    s = flat.segments(f, kp1)
    for kmer_format in (False, True):
        got = list(zip(s.row.tolist(), (s.start - f.begin[s.row]).tolist(), (s.end - f.begin[s.row]).tolist(), s.good.tolist(), flat.bodies(f, s, kp1, kmer_format).to_pylist(), strict=True))
        want = []
        for i, r in enumerate(rows):
            up = "".join(c.upper() if c.isascii() else c for c in r)
            for a, b, good in plain_segments(r, kp1):
                items = (up[p - kp1 + 1 : p + 1] if kmer_format else up[p] for p in at[i] if a <= p < b)
                want.append((i, a, b, good, up[a : a + kp1 - 1] + "".join(items) if good else up[a:b]))
        assert got == want
    p = flat.pieces(f, kp1)
    assert list(zip(p.row.tolist(), (p.start - f.begin[p.row]).tolist(), (p.end - f.begin[p.row]).tolist(), strict=True)) == [(i, a, b) for i, r in enumerate(rows) for a, b in plain_pieces(r, at[i], kp1)]
    assert not s.goes_on.any() and not p.goes_on.any()


def test_one_long_sequence_is_many_tasks(spark):
    rng = np.random.default_rng(3)
    text = "".join(np.array(list("ACGT"))[rng.integers(0, 4, 300_000)])
    df = spark.createDataFrame([(1, text)], "seq_id long, seq string")
    branches = graph.multi_out(graph.edge_rows(df, 10), distinct=True)
    _, _, blocks = brc.cut_blocks(df, 10, 4096)
    assert blocks.select("block").distinct().count() == -(-300_000 // 4096)
    assert blocks.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 1
    a, b = (f(df, branches, 10).select("brc_id", "len", "start", "type", "brc").collect() for f in (brc.walk, lambda *x: brc.walk_blocks(*x, size=4096)))
    assert a == b and a[0].len == 300_000


@pytest.mark.parametrize("kp1", [2, 7, 31, 32])
def test_branches_in_one_pass(spark, kp1, monkeypatch):
    """Folded where they are made, as from the edges, on both sides, with codes of 32 bases too."""
    rng = random.Random(kp1)
    shared = "".join(rng.choices("ACGT", k=50))
    rows = texts(rng) + [(9, shared + x * 9) for x in "ACGT"] + [(9, x * 3 + shared) for x in "ACGT"] + [(1, "T" * 70)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    edges = kmer_codes(df, kp1).select("code").distinct()
    codes = lambda df: sorted(r.code for r in df.collect())
    o, i = codes(graph.multi_out(edges)), codes(graph.multi_in(edges, kp1))
    assert codes(graph.branches(df, kp1)) == o and codes(graph.branches(df, kp1, out=False, into=True)) == i
    assert codes(graph.branches(df, kp1, into=True)) == sorted(o + i) and o and i
    assert graph.branches(df.where("false"), kp1, into=True).count() == 0


def test_only_parts_at_the_ends_of_blocks_are_written(spark, monkeypatch):
    """Records inside a block are neither written nor shuffled; they were both, with all that came along."""
    from kmerspark.operators import blockwise

    rng = random.Random(8)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGTN", k=3000))) for i in range(4)], "seq_id long, seq string")
    branches, written = graph.branch_set(df, 6, into=True), {}
    plain = blockwise.materialize

    def materialize(df, name, *a):
        out = plain(df, name, *a)
        written[name] = out.count()
        return out

    monkeypatch.setattr(blockwise, "materialize", materialize)
    n = unitigs.cut_unitigs_blocks(df, branches, 6, size=500).count()
    assert written.pop("blocks") == 24 and sum(written.values()) <= 3 * 24 < n
