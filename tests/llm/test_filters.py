"""Quality rules, decontamination and mixing against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kmerspark.llm.decontaminate import decontamination_report, remove_documents, remove_spans
from kmerspark.llm.mixing import fit_budget, mix_sources, mixed_documents
from kmerspark.llm.quality_rules import count_columns, keep_good, posteriors, quality_rules, rules, vote_pattern
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, TEXT2 string"
ODD = [
    (1, None, "a", "x"), (2, "", "a", None), (3, " \t\n ", None, "x"), (4, "one", "b", ""), (5, "a b c a b c a b c", "b", ""), (6, "x\ny\nx\n\n\nx", "b", ""),
    (7, "É È é À # | <b>", None, ""), (8, "w " * 70_000, "c", ""), (4, "one", "b", ""), (None, "null id " * 60, "c", ""), (9, "\U0001f600 😀 a\x0bb\x0cc\rd", "a", ""),
]


def test_quality_counts(spark):
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r.doc_id, *r[1:6]): r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(i, *brute.quality_counts(t)) for i, t in rows}
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    out = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_quality_votes_can_outvote_a_sign(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("bcdfgl") + rng.choice("aeiou") + rng.choice("mnrst") + rng.choice("aeiou") + rng.choice("klmp") for _ in range(n)]
    clean = [" ".join(words(120)) for _ in range(400)]
    loud = [" ".join(w.upper() for w in words(120)) for _ in range(60)]
    junk = [" ".join(f"{w} ##|| %%$" for w in words(60)) for _ in range(40)]
    rows = list(enumerate(clean + loud + junk))
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(460)) and not any(got[i] for i in range(460, 500))
    votes = vote_pattern(count_columns(spark.createDataFrame(rows[400:460], "doc_id long, text string"))).select("pattern").collect()
    place = list(rules()).index("capitals")
    assert all(r.pattern // 3**place % 3 == 2 for r in votes)


def test_quality_empty(spark):
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_broadcast": 0}])
def test_contamination(spark, limits):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(1000, "É è"), (None, "zz yy"), (1001, ""), (1002, None), (1003, "w"), (1003, "one")]
    docs = [(i, t) for i, t, *_ in ODD if i != 8] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()[:60]] + [(900, "Zz, yy."), (901, items[0][1]), (902, f"lead {items[1][1]} tail"), (903, "w w w")]
    out = decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **limits)
    named = [("" if i is None else i, t) for i, t in items]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((i, *brute.contamination(t, named))) for i, t in docs)


def test_contamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination_report(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontamination_report(docs.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_removal(spark):
    items = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so, The quick: fox! ran"), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in remove_documents(docs, items).collect()} == {2, 3}
    assert {r.doc_id: r.text for r in remove_spans(docs, items).collect()} == {1: "so! ran", 2: "clean text", 3: None}


def test_contamination_by_items_of_every_length(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcd") + rng.choice("efgh") for _ in range(n)]
    items = [(n, " ".join(words(n))) for n in range(1, 41)]
    docs = [(i, " ".join(words(rng.choice([0, 1, 5, 40, 200])))) for i in range(60)] + [(100 + n, " ".join([*words(35), t, *words(60)])) for n, t in items]
    want = sorted((i, *brute.contamination(t, items)) for i, t in docs)
    for limits in ({}, {"max_broadcast": 0}):
        out = decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **limits)
        assert sorted(map(tuple, out.collect())) == want


ROWS = "doc_id long, text string, source string, spans string, _row string, fp long, doc string, n long"


def odd_rows(spark, rows):
    """rows(doc_id, text) with columns that clash with those that operators add."""
    return spark.createDataFrame([(i, t, "s", "spans", "row", 7, "doc", 1) for i, t in rows], ROWS)


def test_rows_are_removed_one_by_one(spark):
    items = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    docs = odd_rows(spark, [(None, "the quick fox"), (None, "clean"), (7, "the quick fox"), (7, "clean too"), (7, "clean too"), (8, None), (9, "")])
    left = remove_documents(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(None, "clean"), (7, "clean too"), (7, "clean too"), (8, None), (9, "")]))
    assert sorted(str(r.text) for r in remove_spans(docs, items).collect()) == ["", "", "", "None", "clean", "clean too", "clean too"]
    assert remove_documents(docs.where("false"), items).count() == 0 and remove_documents(docs, items.where("false")).count() == 7


def test_good_rows_are_kept_one_by_one(spark):
    rng = random.Random(6)
    good = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(80))
    docs = odd_rows(spark, [(None, good), (None, "short"), (7, good), (7, good), (7, "short"), (8, None), (9, "")])
    left = keep_good(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["7", "7", "None"] and all(r.text == good and r.doc == "doc" for r in left.collect())
    assert keep_good(docs.where("false")).count() == 0


def plain_posteriors(patterns, k, iterations=40, prior=0.5, on_good=0.9, on_bad=0.6, pseudo=10.0):
    """{pattern: posterior} by the same model, in loops."""
    votes = {p: [p // 3**j % 3 for j in range(k)] for p in patterns}
    good, bad = [on_good] * k, [on_bad] * k
    for step in range(iterations + 1):
        q = {}
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes[p]):
                odds += {0: 0.0, 1: math.log(good[j] / bad[j]), 2: math.log((1 - good[j]) / (1 - bad[j]))}[v]
            q[p] = 1 / (1 + math.exp(-odds))
        if step == iterations:
            return q
        for j in range(k):
            said = {w: [sum(n * (q[p] if w else 1 - q[p]) for p, n in patterns.items() if votes[p][j] in own) for own in ((1,), (1, 2))] for w in (True, False)}
            good[j] = (said[True][0] + pseudo * on_good) / (said[True][1] + pseudo)
            bad[j] = (said[False][0] + pseudo * on_bad) / (said[False][1] + pseudo)


def test_expectation_maximisation_against_a_plain_version(spark):
    rng, k = random.Random(9), len(rules())
    patterns = {sum(rng.choices([0, 1, 2], [2, 5, 1])[0] * 3**j for j in range(k)): rng.randint(1, 500) for _ in range(60)}
    got = {r.pattern: r.posterior for r in posteriors(spark.createDataFrame(list(patterns.items()), "pattern int, n long")).collect()}
    want = plain_posteriors(patterns, k)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 5), min_size=1, max_size=6), st.floats(0, 1))
def test_fit_budget_is_optimal_on_small_sets(counts, part):
    sizes, n = np.array(sorted(counts)), np.array([counts[s] for s in sorted(counts)])
    budget = part * float((sizes * n).sum())
    took = fit_budget(sizes, n, budget)
    assert ((took >= 0) & (took <= n)).all()
    sums = {0}
    for s, c in zip(sizes, n, strict=True):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    assert abs((took * sizes).sum() - budget) <= min(abs(x - budget) for x in sums) + 1


def test_mixing(spark):
    random.seed(3)
    rows = [(i, "w " * random.choice([0, 1, 3, 50, 51, 700]), random.choice(["a", "b", "é", "Z", None])) for i in range(600)] + [(i, "copy text", "a") for i in range(1000, 1300)] + [(2000, None, "q"), (2001, "w " * 40_000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert len(out) == len(rows)
    sizes, took = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute.targets(sizes)
    for r in out:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    for s, t in want.items():
        assert abs(took[s] - t) <= (1 if s not in ("big",) else 40_000)
    assert sorted(map(tuple, mix_sources(df).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in out)
    mixed = defaultdict(int)
    for r in mixed_documents(df).collect():
        mixed[r.source] += len((r.text or "").split())
    assert mixed == {s: n for s, n in took.items() if n}
    assert mix_sources(df.where("false")).count() == 0


def test_mixing_many_lengths_and_odd_rows(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, i, 5]), "w " * rng.randint(0, 900), rng.choice(["a", "b"])) for i in range(2000)] + [(5, "same row " * 20, "c")] * 300
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, size long, copies long, key string")
    out = mixed_documents(df)
    assert out.columns == df.columns
    took, sizes = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    for r in out.collect():
        took[r.source] += len(r.text.split())
    want = brute.targets(sizes)
    assert all(abs(took[s] - want[s]) <= (1 if s != "c" else 40) for s in want)
    assert mixed_documents(df.where("false")).count() == 0
