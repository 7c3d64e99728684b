"""K-mer operators on hand-sized sequences, odd input, and against plain sequential versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kmerspark.functions import codec
from kmerspark.operators import brc, compress, counting, flags, graph, lookup, minimizers, sets, stats, unitigs, windows
from kmerspark.operators.windows import block_codes, kmer_codes, kmer_strings
from kmerspark.sources import tables
from pyspark.sql import functions as F

SEQS = [(1, "ACGTACGANNTTACGTAG"), (2, "acgtacgaacgt"), (3, "AC")]
KP = 4


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "seq_id long, seq string").cache()


@pytest.fixture(scope="module")
def edges(seqs):
    return kmer_codes(seqs, KP).select("code").distinct().cache()


def kmers(df, k=KP, column="code"):
    return sorted(r[0] for r in df.select(codec.decode(column, k)).collect())


def code(s):
    n = 0
    for c in s:
        n = n * 4 + "ACGT".index(c)
    return n


def test_counts(seqs):
    got = {r.kmer: r.cnt for r in counting.with_kmers(counting.count_kmers(seqs, KP), KP).collect()}
    assert got == {"AACG": 1, "ACGA": 2, "ACGT": 4, "CGAA": 1, "CGTA": 3, "GAAC": 1, "GTAC": 2, "GTAG": 1, "TACG": 3, "TTAC": 1}
    assert sorted(r.code for r in counting.count_kmers(seqs, KP).collect()) == [6, 24, 27, 96, 108, 129, 177, 178, 198, 241]


def test_branches(edges):
    assert kmers(graph.multi_out(edges)) == ["ACGA", "ACGT", "GTAC", "GTAG"]
    assert kmers(graph.multi_in(edges, KP)) == ["AACG", "GTAC", "TACG", "TTAC"]
    masks = {r[0]: r[1] for r in graph.successor_masks(edges).select(codec.decode("kmer", 3), "mask").collect()}
    assert masks == {"AAC": 4, "ACG": 9, "CGA": 1, "CGT": 1, "GAA": 2, "GTA": 6, "TAC": 4, "TTA": 2}


def test_repeated_rows_branch_unless_distinct(spark):
    twice = spark.createDataFrame([(code("AAAC"),), (code("AAAC"),)], "code long")
    assert kmers(graph.multi_out(twice)) == ["AAAC"] and kmers(graph.multi_out(twice, distinct=True)) == []


def test_walk_and_restore(seqs, edges):
    o = graph.multi_out(edges)
    records = brc.walk(seqs, o, KP)
    got = {(r.seq_id, r.brc_id): (r.len, r.start, r.type, r.brc) for r in records.collect()}
    assert got == {(1, 0): (8, 0, "good", "ACGTCA"), (1, 1): (2, 8, "bad", "NN"), (1, 2): (8, 10, "good", "TTATG"), (2, 0): (12, 0, "good", "ACGTCAT"), (3, 0): (2, 0, "bad", "AC")}
    long = brc.walk(seqs, o, KP, kmer_format=True)
    assert {(r.seq_id, r.brc_id): r.brc for r in long.collect()} == {(1, 0): "ACGACGTGTACACGA", (1, 1): "NN", (1, 2): "TTAACGTGTAG", (2, 0): "ACGACGTGTACACGAACGT", (3, 0): "AC"}
    assert sorted((r.seq_id, r.brc_id) for r in brc.walk(seqs, o, KP, pass_special=True).collect()) == [(1, 0), (1, 2), (2, 0)]
    want = {i: s.upper() for i, s in SEQS}
    assert {r.seq_id: r.seq for r in brc.restore(records, edges, KP).collect()} == want
    assert {r.seq_id: r.seq for r in brc.restore(long, edges, KP, kmer_format=True).collect()} == want
    assert {(r.seq_id, r.brc_id, r.len, r.start, r.type) for r in brc.segments(seqs, KP).collect()} == {(*k, *v[:3]) for k, v in got.items()}
    back = brc.from_text(brc.to_text(records))
    assert {(int(r.name), r.brc_id, r.brc) for r in back.collect()} == {(*k, v[3]) for k, v in got.items()}
    with pytest.raises(ValueError):
        brc.restore(records, edges, KP, max_edges=3)


def test_unitigs(seqs, edges):
    both = sets.merge([graph.multi_out(edges), graph.multi_in(edges, KP)], distinct=True)
    cut = unitigs.cut_unitigs(seqs, both, KP).cache()
    by = defaultdict(list)
    for r in sorted(cut.collect()):
        by[r.seq_id].append(f"{r.unitig}@{r.start}")
    assert " ".join(by[1]) == "ACG@0 CGTA@1 TAC@3 ACG@4 CGA@5 NN@8 TTA@10 TAC@11 ACG@12 CGTA@13 TAG@15"
    assert " ".join(by[2]) == "acg@0 cgta@1 tac@3 acg@4 cgaac@5 acg@8 cgt@9" and by[3] == ["AC@0"]
    kept = defaultdict(list)
    for r in sorted(unitigs.dedup_unitigs(cut, 3).collect()):
        kept[r.seq_id].append(r.idx)
    assert kept == {1: [0, 1, 10], 2: [0, 4, 6], 3: [0]}


def test_flags(seqs, edges):
    assert {r.seq_id: r.flagged for r in flags.flag_branches(seqs, graph.multi_out(edges), KP).collect()} == {1: "ACG3A1G0NNTTACG3A2", 2: "acg3a1g0acg3", 3: "AC"}


def test_deltas(edges):
    assert sorted((r.x, r.y) for r in stats.delta_histogram(edges).collect()) == sorted(Counter([18, 3, 69, 12, 21, 48, 1, 20, 43]).items())


ODD = [(1, None), (2, ""), (3, "NNNN"), (4, "ACGT"), (5, "NACGTN"), (6, "ACG"), (7, "ACGNACG"), (8, "é" * 5 + "ACGTACGT" + "é" + "\U0001f600ACGTT"), (9, "AC-GTAC|GTTTT"), (10, "ACGTTGCA" * 30_000)]


def test_odd_sequences(spark):
    df = spark.createDataFrame(ODD, "seq_id long, seq string")
    got = sorted((r.seq_id, r.pos, r.kmer) for r in counting.with_kmers(kmer_codes(df, 4, size=1000), 4).collect())
    assert got == sorted(map(tuple, kmer_strings(df, 4).select("seq_id", "pos", "kmer").collect()))
    edges = kmer_codes(df, 4).select("code").distinct()
    o = graph.multi_out(edges)
    back = {r.seq_id: r.seq for r in brc.restore(brc.walk(df, o, 4), edges, 4).collect()}
    assert back == {i: s or "" for i, s in ODD}
    for r in unitigs.cut_unitigs(df, o, 4).where("seq_id < 10").collect():
        assert (dict(ODD)[r.seq_id] or "")[r.start : r.start + len(r.unitig)] == r.unitig
    nothing = df.where("false")
    assert counting.count_kmers(nothing, 4).count() == brc.walk(nothing, o, 4).count() == 0
    assert brc.walk(df, o.where("false"), 4).count() > 0
    totals = counting.count_totals(nothing, 4).first()
    assert (totals.total, totals.distinct_kmers, totals.sequences) == (0, 0, 0)


def random_seqs(rng, n=6, length=60, special=0.04):
    return [(i, "".join("N" if rng.random() < special else rng.choice("ACGTacgt"[: rng.choice([4, 8])]) for _ in range(rng.randint(0, length)))) for i in range(n)]


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 3), (3, 4), (4, 5)])
def test_round_trips(spark, seed, k):
    rng = random.Random(seed)
    rows = random_seqs(rng, 20, 120)
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    edges = kmer_codes(df, k + 1).select("code").distinct()
    o, want = graph.multi_out(edges), {i: s.upper() for i, s in rows}
    both = sets.merge([o, graph.multi_in(edges, k + 1)], distinct=True)
    for kmer_format in (False, True):
        assert {r.seq_id: r.seq for r in brc.restore(brc.walk(df, o, k + 1, kmer_format), edges, k + 1, kmer_format).collect()} == want
        assert {r.seq_id: r.seq for r in brc.restore(brc.walk(df, both, k + 1, kmer_format), edges, k + 1, kmer_format, branch_set=both).collect()} == want
    apart = brc.with_groups(df.withColumn("row", F.col("seq_id")), 300)
    for kmer_format, marks in ((False, o), (True, o), (False, both)):
        back = brc.restore_by_group(brc.walk(apart, marks, k + 1, kmer_format), brc.group_edges(apart, marks, k + 1), k + 1, kmer_format)
        assert {r.seq_id: r.seq for r in back.collect()} == want and back.select("grp").distinct().count() > 1
    pieces = defaultdict(list)
    for r in sorted(unitigs.cut_unitigs(df, both, k + 1).collect()):
        pieces[r.seq_id].append(r)
    for i, s in rows:
        text, end = "", 0
        for r in pieces[i]:
            text += r.unitig[end - r.start :] if r.start < end else r.unitig
            end = r.start + len(r.unitig)
        assert text == s


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTacgtN-x", max_size=80), st.integers(1, 32))
def test_block_codes(text, k):
    at, codes = block_codes(np.frombuffer(text.encode(), np.uint8), k)
    want = [(i, code(text[i : i + k].upper())) for i in range(len(text) - k + 1) if set(text[i : i + k].upper()) <= set("ACGT")]
    assert [(int(a), int(c) % 2**64) for a, c in zip(at, codes, strict=True)] == want


def test_codec(spark):
    rows = ["A", "T" * 32, "ACGT" * 8, "acgt", "G" * 31, "ACN", "", "C" * 33]
    df = spark.createDataFrame([(r,) for r in rows], "kmer string").withColumn("code", codec.encode("kmer"))
    for r in df.collect():
        ok = 0 < len(r.kmer) <= 32 and set(r.kmer.upper()) <= set("ACGT")
        assert (r.code is not None) == ok and (not ok or r.code % 2**64 == code(r.kmer.upper()))
    big = spark.createDataFrame([("T" * 32,), ("A" * 32,), ("G" * 32,), ("C" * 32,)], "kmer string").withColumn("code", codec.encode("kmer"))
    assert [r[0][0] for r in big.orderBy(codec.unsigned_order("code")).select(codec.decode("code", 32)).collect()] == list("ACGT")
    one = df.where("kmer = 'acgt'").select(codec.rotate("kmer", 1), codec.rotate("kmer", -1), codec.rotate("kmer", 5), codec.revcomp("kmer"), codec.canonical("kmer"), codec.symbol_at("kmer", 4), codec.symbol_at("kmer", 0)).first()
    assert tuple(one) == ("tacg", "cgta", "tacg", "ACGT", "ACGT", None, "a")
    assert [r[0] for r in spark.createDataFrame([("a",), ("T",), ("-",), ("n",), ("",)], "b string").select(codec.base_code("b")).collect()] == [0, 3, 5, 4, 4]
    with pytest.raises(ValueError):
        codec.check_k(33)


def test_set_operations(spark):
    a = spark.createDataFrame([(5,), (1,), (1,), (9,), (-1,)], "code long")
    b = spark.createDataFrame([(1,), (7,), (9,), (9,)], "code long")
    rows = lambda df: sorted(r[0] for r in df.collect())
    assert rows(sets.merge([a, b])) == [-1, 1, 1, 1, 5, 7, 9, 9, 9] and rows(sets.merge([a, b], distinct=True)) == [-1, 1, 5, 7, 9]
    assert rows(sets.difference(a, b)) == [-1, 1, 5] and rows(sets.difference(b, a)) == [7, 9] and rows(sets.difference(a, a)) == []
    assert tuple(sets.compare_info(a, b, 4).first()) == (4, 5, 4, 3, 2) and rows(sets.intersection(a, b)) == [1, 9]
    file = sets.with_positions(a).cache()
    assert [r.code for r in file.orderBy("pos").collect()] == [1, 1, 5, 9, -1]
    assert tuple(sets.check_order(file).first()) == (5, True, None) and tuple(sets.check_order(file, strict=True).first()) == (5, False, 1)
    wrong = spark.createDataFrame([(i, -i) for i in range(5)] + [(i, i) for i in range(5, 200_000)], "pos long, code long")
    assert sets.check_order(wrong).first().first_violation == 2  # -1, the largest code, may follow 0
    broken = spark.createDataFrame([(i, i if i != 65_536 else 0) for i in range(65_530, 65_540)], "pos long, code long")
    assert sets.check_order(broken).first().first_violation == 65_536
    found = {r.code: r.pos for r in sets.search(file, spark.createDataFrame([(1,), (2,), (-1,)], "code long")).collect()}
    assert found == {1: 0, 2: None, -1: 4}
    assert [r.pos for r in sets.view(file, 2, tail=True).collect()] == [4, 3]
    assert sets.check_order(file.where("false")).first().n == 0


def test_lookups(spark):
    counts = spark.createDataFrame([(code("ACG"), 5), (code("CGT"), 2)], "code long, cnt long")
    reads = spark.createDataFrame([(1, "ACGTNACG"), (2, "AC"), (3, None), (4, "TTTT")], "seq_id long, seq string")
    got = {r.seq_id: list(r.counters) for r in lookup.read_counters(reads, counts, 3).collect()}
    assert got == {1: [5, 2, 0, 0, 0, 5], 2: [], 3: [], 4: [0, 0]}
    folded = {r.seq_id: list(r.counters) for r in lookup.read_counters(reads, counts.where("cnt = 5"), 3, canonical=True).collect()}
    assert folded[1] == [5, 5, 0, 0, 0, 5]


def normal(mmer, m):
    import re

    rc = mmer[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return min(4**m if re.search(codec.REFUSED, x) else code(x) for x in (mmer, rc))


def test_minimizers(spark):
    rng = random.Random(8)
    rows = random_seqs(rng, 12, 90)
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    k, m, want = 9, 5, {}
    for i, s in rows:
        s = s.upper()
        for p in range(len(s) - k + 1):
            if set(s[p : p + k]) <= set("ACGT"):
                want[i, p] = min(normal(s[p + j : p + j + m], m) for j in range(k - m + 1))
    assert {(r.seq_id, r.pos): r.signature for r in minimizers.signatures(df, k, m).collect()} == want
    covered = {}
    for r in minimizers.super_kmers(df, k, m).collect():
        for p in range(r.start, r.start + r.len - k + 1):
            assert (r.seq_id, p) not in covered
            covered[r.seq_id, p] = r.signature
    assert covered == want


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 1000), min_size=1, max_size=12))
def test_huffman(counts):
    book = compress.codebook(counts)
    words = sorted(book.values())
    assert len(set(words)) == len(counts) and not any(b.startswith(a) for a, b in zip(words, words[1:]))
    heap = sorted(counts.values())
    best = 0 if len(heap) > 1 else heap[0]
    while len(heap) > 1:
        a, b, *heap = sorted(heap)
        best += a + b
        heap.append(a + b)
    assert sum(counts[s] * len(w) for s, w in book.items()) == best


def test_codecs(spark):
    rows = spark.createDataFrame([(1, "aaab"), (2, ""), (3, "x\n\n"), (4, "é" * 300)], "row long, s string")
    runs = compress.rle_runs(rows)
    assert sorted(map(tuple, runs.collect())) == [(1, 0, "a", 3), (1, 3, "b", 1), (3, 0, "x", 1), (3, 1, "\n", 2), (4, 0, "é", 300)]
    digits = {r.length: list(r.digits) for r in compress.rle_digits(runs).collect()}
    assert digits[300] == [256, 259, 258, 256, 257] and digits[3] == [259]
    block = spark.createDataFrame([(0, i, s) for i, s in enumerate(["abc", "bbc", "aac", "bab"])], "block long, row long, s string")
    assert [r.s for r in compress.pbwt_decode(compress.pbwt_encode(block, 3)).orderBy("row").collect()] == ["abc", "bbc", "aac", "bab"]
    data = spark.createDataFrame([(1, bytes(range(256))), (2, b""), (3, b"\x1b")], "id long, data binary")
    out = compress.bytes_to_bases(data, 100)
    got = {(r.id, r.frag): r.bases for r in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 0)} and got[3, 0] == "ACGT"
    assert bytes(code((got[1, 0] + got[1, 1] + got[1, 2])[i : i + 4]) for i in range(0, 1024, 4)) == bytes(range(256))
    assert out.where("id = 3").select(compress.bases_to_bytes(F.col("bases"))).first()[0] == b"\x1b"


@pytest.mark.parametrize("kp1", [4, 9, 32])
@pytest.mark.parametrize("kmer_format", [False, True])
def test_records_decode_alike_in_step_and_alone(spark, monkeypatch, kp1, kmer_format):
    rng = random.Random(kp1)
    unit = "".join(rng.choice("ACGT") for _ in range(50))
    rows = [(i, "T" * (40 * (i == 0)) + "".join(unit[rng.randrange(10) :] for _ in range(rng.randint(1, 9)))) for i in range(40)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    edges = kmer_codes(df, kp1).select("code").distinct()
    o = graph.multi_out(edges)
    both = sets.merge([o, graph.multi_in(edges, kp1)], distinct=True)
    table = sorted(tuple(r) for r in graph.successor_masks(edges).collect())
    nodes, masks = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.uint8)
    for used, skip in ((o, None), (both, np.sort(np.array([r.code for r in both.collect()], np.int64)))):
        records = sorted(brc.walk(df, used, kp1, kmer_format).where("type = 'good'").collect(), key=lambda r: r.seq_id)
        texts, lengths = [r.brc for r in records], [r.len for r in records]
        for alone in (0, 7, 1000):
            monkeypatch.setattr(brc, "ALONE", alone)
            assert brc.restore_records(texts, lengths, kp1 - 1, nodes, masks, skip, kmer_format) == [s for _, s in rows]
            with pytest.raises(ValueError):
                brc.restore_records(texts, [n + 1000 for n in lengths], kp1 - 1, nodes, masks, skip, kmer_format)


REPEATED = [(5, "ACGTACGANNTTACGTAG"), (5, "acgtacgaacgt"), (None, "TTACGTAGACGA"), (None, "ACGTACGANNTTACGTAG"), (5, None), (None, ""), (6, "éACGTACGA")]


@pytest.mark.parametrize("kw", [{}, {"max_set": 0}])
def test_repeated_and_null_ids(spark, kw):
    """Rows that share an id are sequences of their own, by broadcast and by shuffle."""
    df = spark.createDataFrame([(i, s, f"name {n}", 9) for n, (i, s) in enumerate(REPEATED)], "seq_id long, seq string, name string, _at int")
    kmers = kmer_codes(df, KP).select("code").distinct()
    o = graph.multi_out(kmers)
    upper = {f"name {n}": "".join(c.upper() if c.isascii() else c for c in s or "") for n, (_, s) in enumerate(REPEATED)}
    back = brc.restore(brc.walk(df, o, KP, **kw), kmers, KP)
    assert {r.name: (r.seq_id, r.seq, r["_at"]) for r in back.collect()} == {f"name {n}": (i, upper[f"name {n}"], 9) for n, (i, _) in enumerate(REPEATED)}
    alone = {}
    for n, (_, s) in enumerate(REPEATED):
        one = spark.createDataFrame([(1, s)], "seq_id long, seq string")
        alone[f"name {n}"] = (flags.flag_branches(one, o, KP).first().flagged, [(r.start, r.unitig) for r in unitigs.cut_unitigs(one, o, KP).orderBy("idx").collect()])
    flagged = {r.name: r.flagged for r in flags.flag_branches(df, o, KP, **kw).collect()}
    pieces = {}
    for r in unitigs.cut_unitigs(df, o, KP, **kw).orderBy("idx").collect():
        pieces.setdefault(r.name, []).append((r.start, r.unitig))
    assert {n: (flagged[n], pieces[n]) for n in flagged} == alone
    assert sorted((r.name, r.start, r.len) for r in brc.segments(df, KP).collect()) == sorted((r.name, r.start, r.len) for r in brc.walk(df, o, KP, **kw).collect())
    counts = counting.count_kmers(df, KP)
    assert sorted((str(r.seq_id), r.n) for r in lookup.read_counters(df, counts, KP).collect()) == sorted((str(i), max(0, len(s or "") - KP + 1)) for i, s in REPEATED)
    assert minimizers.super_kmers(df, 7, 5).count() == sum(minimizers.super_kmers(df.where(f"name = 'name {n}'"), 7, 5).count() for n in range(len(REPEATED)))


def test_blocks_do_not_change_what_runs_over_them(spark):
    rng = random.Random(21)
    df = spark.createDataFrame([(1, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=700))), (1, "A" * 300 + "C" * 90), (2, "ACGT" * 40), (3, "")], "seq_id long, seq string")
    whole = sorted(map(tuple, minimizers.super_kmers(df, 12, 5).collect()))
    for size in (3, 64, 100):
        for spread in (False, True):
            assert sorted(map(tuple, minimizers.super_kmers(df, 12, 5, size, spread).collect())) == whole
            assert sorted(map(tuple, minimizers.signatures(df, 12, 5, size, spread).collect())) == sorted(map(tuple, minimizers.signatures(df, 12, 5).collect()))
    assert sorted(map(tuple, counting.count_kmers(df, 12, spread=True).collect())) == sorted(map(tuple, counting.count_kmers(df, 12).collect()))


@pytest.mark.parametrize("m", [5, 6])
def test_normal_mmers(spark, m):
    rows = spark.range(4**m).select("id", codec.normal_mmer(codec.decode("id", m), m).alias("v")).orderBy("id").collect()
    assert [r.v for r in rows] == minimizers.normal_mmers(m).tolist()


def test_one_frequent_kmer_sorts_in_several_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(77).alias("code")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = sets.sort_kmers(rows).withColumn("range", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.code for r in ordered] == sorted(r.code for r in rows.collect()) and max(Counter(r["range"] for r in ordered).values()) < 10_000
    assert stats.delta_histogram(rows).where("x = 0").first().y == 17_999
    with pytest.raises(Exception, match="cells"):
        compress.pbwt_encode(spark.createDataFrame([(0, i, "ab") for i in range(9)], "block long, row long, s string"), 2, max_cells=4).collect()


def test_groups_are_decoded_on_odd_rows(spark):
    rows = [(1, 7, "ACGTACGA"), (2, 7, None), (3, None, "acgtacgtNN\u00e9"), (4, 7, ""), (5, 8, "ACGTACGA"), (6, 8, "A" * 5000)]
    df = spark.createDataFrame(rows, "row long, seq_id long, seq string")
    o = graph.multi_out(graph.edge_rows(df, 4), distinct=True)
    for bases in (1, 1 << 20):  # a group for every base, or one
        apart = brc.with_groups(df, bases)
        back = brc.restore_by_group(brc.walk(apart, o, 4), brc.group_edges(apart, o, 4), 4).collect()
        assert sorted((r.row, r.seq) for r in back) == [(1, "ACGTACGA"), (2, ""), (3, "ACGTACGTNN\u00e9"), (4, ""), (5, "ACGTACGA"), (6, "A" * 5000)]
        assert {r.row: r.seq_id for r in back} == {r[0]: r[1] for r in rows}
    with pytest.raises(Exception, match="edges; at most 2"):
        brc.restore_by_group(brc.walk(apart, o, 4), brc.group_edges(apart, o, 4), 4, max_edges=2).collect()
    nothing = brc.with_groups(df.where("false"))
    assert brc.restore_by_group(brc.walk(nothing, o, 4), brc.group_edges(nothing, o, 4), 4).count() == 0


def test_pieces_are_made_once(spark):
    """Outer and inner pieces come from one pass over the sequences, and so do blocks from one evaluation of a text."""
    seqs = spark.createDataFrame([(1, "ACGTTACGATTGACCATGAC"), (None, "ACGTTACGATTGACCATGAC"), (2, "AC"), (3, None)], "seq_id long, seq string").withColumn("seq", F.translate("seq", "x", "N"))
    made = unitigs.dedup_unitigs(unitigs.cut_unitigs(seqs, graph.branch_set(seqs, 5, into=True), 5), 4)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert windows.blocks(seqs, 5)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert sorted((r.seq_id, r.block.decode()) for r in windows.blocks(seqs.na.fill(0, ["seq_id"]), 5).collect()) == [(0, "ACGTTACGATTGACCATGAC"), (1, "ACGTTACGATTGACCATGAC")]
    assert made.where("outer AND seq_id IS NULL").count() == made.where("outer AND seq_id = 1").count() > 0


def test_short_inner_pieces_are_left_out_where_they_are_made(spark):
    rng = np.random.default_rng(8)
    seqs = spark.createDataFrame([(i, "".join(rng.choice(list("ACGTN"), 80 * i, p=[0.3, 0.3, 0.19, 0.19, 0.02]))) for i in range(5)] + [(9, None)], "seq_id long, seq string")
    branches = graph.branch_set(seqs, 5, into=True)
    whole, some = unitigs.cut_unitigs(seqs, branches, 5), unitigs.cut_unitigs(seqs, branches, 5, inner_over=4)
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.where("outer OR length(unitig) > 4").collect()))
    assert sorted(map(str, unitigs.dedup_unitigs(some, 4).collect())) == sorted(map(str, unitigs.dedup_unitigs(whole, 4).collect()))


def test_bases_of_any_character(spark):
    """As the SQL has it; and characters of a code below 128 are not left to the pattern."""
    texts = ["".join(map(chr, range(128))), "aB\x00z\U0001f600\u0130\u212aé\r\n\tN#\\$1", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tables.to_bases(F.col("text")).alias("seq"))
    old = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z \n]", "#"), tables.LETTERS, tables.AS_BASES)
    assert got.where(F.col("seq") != old).count() == 0 and got.where("seq IS NULL").count() == 0
    assert all(c in tables.LETTERS + tables._SPECIAL or c.isupper() for c in map(chr, range(1, 128)))
