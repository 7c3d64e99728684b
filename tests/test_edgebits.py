"""Sets of edges as bits against the same as codes, and what is made with either."""

import random

import pytest

from kmerspark.operators import brc, edgebits, flags, graph, unitigs
from kmerspark.operators.windows import kmer_codes

from tests.test_blocks import texts


def codes(df):
    return sorted({r.code for r in df.collect()})


@pytest.mark.parametrize("kp1", [3, 7, 15])
def test_bits_are_the_codes(spark, kp1):
    rng = random.Random(kp1)
    shared = "".join(rng.choices("ACGT", k=50))
    rows = texts(rng) + [(9, shared + x * 9) for x in "ACGT"] + [(9, x * 3 + shared) for x in "ACGT"] + [(1, "T" * 70)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    edges = kmer_codes(df, kp1).select("code")
    want = {(): codes(edges), ("out",): codes(graph.multi_out(edges.distinct())), ("into",): codes(graph.multi_in(edges.distinct(), kp1))}
    want["out", "into"] = sorted({*want["out",], *want["into",]})
    for kw, own in want.items():
        assert codes(edgebits.to_codes(edgebits.of_sequences(df, kp1, **dict.fromkeys(kw, True)), kp1)) == own and own
    assert codes(edgebits.to_codes(edgebits.of_codes(edges, kp1), kp1)) == want[()]
    assert edgebits.of_sequences(df.where("false"), kp1, out=True).count() == 0
    held = edgebits.collected(edgebits.of_sequences(df, kp1), kp1)
    every = edges.distinct().toArrow().column(0).to_numpy()
    assert held.has(every).all() and not held.has(every ^ 1)[[int(c) ^ 1 not in set(want[()]) for c in every]].any()
    masks = {r.kmer: r["mask"] for r in graph.successor_masks(edges).collect()}
    nodes = every >> 2
    assert held.masks(nodes).tolist() == [masks[n] for n in nodes.tolist()]


def test_a_large_set_of_short_edges_shuffles_no_windows(spark, monkeypatch):
    """Beyond max_set windows met branches in a join, a row for each of both."""
    df = spark.createDataFrame(texts(random.Random(2)), "seq_id long, seq string")
    o = graph.branches(df, 6, into=True)
    key = lambda df: sorted(map(repr, df.drop("row").collect()))
    want = [key(brc.walk(df, o, 6)), key(unitigs.cut_unitigs(df, o, 6)), key(flags.flag_branches(df, o, 6))]
    bits = graph.branch_set(df, 6, into=True)
    assert edgebits.is_bits(bits) and not edgebits.is_bits(graph.branch_set(df, 16))
    by_join = key(unitigs.cut_unitigs(df, bits, 6, max_set=0))
    monkeypatch.setattr(flags, "branch_positions", lambda *_: pytest.fail("windows are shuffled"))
    for given in ({"branches": o, "max_set": 2}, {"branches": bits}):
        assert [key(f(df, kp1=6, **given)) for f in (brc.walk, unitigs.cut_unitigs, flags.flag_branches)] == want
    assert by_join == want[1]


@pytest.mark.parametrize("kmer_format", [False, True])
def test_restore_from_bits(spark, kmer_format, monkeypatch):
    """A graph of short edges is no longer bounded by a count of k-mers, and long batches are cut."""
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(texts(random.Random(3)))], "seq_id long, seq string")
    edges = kmer_codes(df, 7).select("code")
    both = graph.branches(df, 7, into=True)
    want = {r.seq_id: r.seq for r in brc.restore(brc.walk(df, both, 7, kmer_format), edges, 7, kmer_format, branch_set=both, max_edges=300).collect()}
    assert want == {i: "".join(c.upper() if c.isascii() else c for c in s or "") for i, (_, s) in enumerate(texts(random.Random(3)))}
    bits = edgebits.of_sequences(df, 7)
    several = edgebits.several(bits, 7, into=True)
    for together in (1, 50, 1 << 20):
        monkeypatch.setattr(brc, "TOGETHER", together)
        back = brc.restore(brc.walk(df, several, 7, kmer_format), bits, 7, kmer_format, branch_set=several, max_edges=1)
        assert {r.seq_id: r.seq for r in back.collect()} == want
    rows = spark.createDataFrame([(0, 0, "ACGT" * 4)], "seq_id long, row long, seq string")
    with pytest.raises(Exception, match="no successor"):
        brc.restore(brc.walk(rows, edgebits.of_sequences(rows, 7, out=True), 7), edgebits.of_sequences(rows.where("false"), 7), 7).collect()


def test_texts_are_looked_at_in_small_slices():
    """What is made of a byte of text may take a thousand, so two million at once were two gigabytes."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ACGT" * 50_000] * 10)], ["seq"])
    slices = list(flags._slices(batch, 0))
    assert sum(s.num_rows for s in slices) == 10 and max(s.num_rows for s in slices) == 2


def _random_blocks(n):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    return [pa.RecordBatch.from_arrays([pa.array([np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, 10_000)].tobytes()] * 10)], ["block"]) for _ in range(n)]


def _peak(work):
    """What work gives, and the megabytes of Python and numpy that it had at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_windows_are_set_as_bits_a_few_at_once():
    """Two million codes at once took 90 MB of each worker, for a set of 32 KB."""
    given = _random_blocks(25)
    made, mb = _peak(lambda: list(edgebits._folded(iter(given), 9)))
    assert len(made) == 4 and mb < 20


def test_windows_are_counted_in_place():
    """Of codes there were two more copies, and a place for each."""
    import numpy as np

    from kmerspark.operators import windows

    held = [np.random.default_rng(i).integers(-(1 << 15), 1 << 15, 1 << 17) for i in range(16)]
    code, n = np.unique(np.concatenate(held), return_counts=True)
    made, mb = _peak(lambda: windows._counted(held))
    assert made.column(0).to_pylist() == code.tolist() and made.column(1).to_pylist() == n.tolist() and not held
    assert mb < 1.5 * 8 * (1 << 21) / 1e6
    assert windows._counted([code[:1]]).to_pydict() == {"code": [code[0]], "n": [1]}


def test_rows_are_looked_at_a_hundred_thousand_bytes_at_once(spark):
    """A slice was four times as long, and a byte of it takes over a hundred as arrays."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import StructType

    df = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('ACGT', 5000) AS seq")
    make = lambda flat: (np.arange(flat.n), [pa.array(np.full(flat.n, len(flat.chars)))])
    seen = flags.each_sequence(df, None, 5, make, StructType().add("together", "long")).collect()
    assert sorted(r.id for r in seen) == list(range(60)) and max(r.together for r in seen) <= 1 << 17
