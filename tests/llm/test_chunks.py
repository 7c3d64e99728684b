"""Content-defined chunks: cuts, shared passages and their removal."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kmerspark.llm import chunks


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600))
def test_cuts_cover_and_match_the_definition(data):
    raw = np.frombuffer(data, np.uint8)
    ends = chunks.cuts(raw)
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends)) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
    h = [sum(int(chunks.GEAR[data[i - j]]) << j for j in range(chunks.SPAN) if i >= j) % 2**32 for i in range(len(data))]
    r = chunks.REACH
    least = {i + 1 for i in range(r, len(data) - r) if min(range(i - r, i + r + 1), key=lambda k: (h[k], k)) == i}
    assert least <= set(ends)


def test_insertions_move_only_the_cuts_around_them():
    rng = random.Random(1)
    text = words(rng, 400).encode()

    def cut(raw):
        ends = chunks.cuts(np.frombuffer(raw, np.uint8))
        return {raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    before, after = cut(text), cut(text[:900] + b"INSERTED" + text[900:])
    assert len(before - after) <= 4


def corpus(rng):
    passage, lead = words(rng, 70), words(rng, 8)
    docs = [(i, f"{lead}\n{words(rng, 120)}") for i in range(40)]
    docs[3] = (3, f"{words(rng, 60)} {passage} {words(rng, 50)}")
    docs[17] = (17, f"{words(rng, 90)} {passage}")
    docs[21] = (21, f"{passage} {words(rng, 30)} {passage}")
    docs += [(100 + i, "copy of all " + passage[:200] + words(random.Random(9), 60)) for i in range(30)]
    docs += [(200, None), (201, ""), (None, passage), (202, "one " * 50_000), (203, words(rng, 40)), (203, words(rng, 40))]
    return docs, passage


def test_shared_passages_are_found_and_clean_documents_are_not(spark):
    docs, passage = corpus(random.Random(3))
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, size string, row string")
    out = chunks.repeated_passages(df).collect()
    assert {r.doc_id for r in out} == {3, 17, 21, *range(100, 130)}
    assert {r.doc_id for r in out if r.is_first} <= {3, 100}
    assert {r.first_doc_id for r in out if r.doc_id in (17, 21)} == {3}
    for r in out:
        text = next(t for i, t in docs if i == r.doc_id)
        cut = text.encode()[r.start : r.start + r.size]
        assert sum(cut in (t or "").encode() for i, t in docs if i is not None) > 1
    assert chunks.repeated_passages(df.where("false")).count() == 0


def test_removal_keeps_the_first(spark):
    docs, passage = corpus(random.Random(4))
    docs = [d for d in docs if d[0] not in (203, None)]
    odd = spark.createDataFrame([(*d, 1, "r", "s") for d in [*docs, (None, passage), (17, passage)]], "doc_id long, text string, _row int, row string, _spans string")
    left = chunks.remove_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(docs) + 2
    assert [r.text for r in left.where("doc_id is null").collect()] == [passage] and passage[120:320] not in "".join(r.text for r in left.where("doc_id = 17").collect())
    out = {r.doc_id: r.text for r in chunks.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    before = dict(docs)
    assert out[3] == before[3] and out[200] is None and out[201] == "" and out[5] == before[5]
    middle = passage[120:320]
    assert middle in out[3] and middle not in out[17] and middle not in out[21]


def test_text_that_is_first_in_a_run_survives(spark):
    rng = random.Random(6)
    a, b = words(rng, 60), words(rng, 60)
    docs = {3: f"{words(rng, 40)} {a} {words(rng, 40)}", 5: f"{a} {b}", 9: f"{a} {b}"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = chunks.chunked(df.withColumn("row", F.col("doc_id"))).collect()
    kept = {r.doc_id: r.text for r in chunks.remove_repeats(df).collect()}
    assert all(any(docs[r.doc_id].encode()[r.start : r.start + r.size] in t.encode() for t in kept.values()) for r in rows)
    assert kept[3] == docs[3] and b[60:] in kept[5] and a[60:-60] not in kept[5] and kept[9] == ""
    found = chunks.repeated_passages(df).collect()
    assert {(r.doc_id, p.first_doc_id) for r in found for p in r.parts} == {(3, 3), (5, 3), (5, 5), (9, 3), (9, 5)}
    assert all([(p.start + p.size) for p in r.parts[:-1]] == [p.start for p in r.parts[1:]] and sum(p.size for p in r.parts) == r.size for r in found)


def test_removal_of_text_with_wide_characters(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("äéßжд語 ", k=500))
    docs = {i: f"{words(rng, 40)} {passage} {words(rng, 40)}" for i in range(4)}
    out = {r.doc_id: r.text for r in chunks.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert out[0] == docs[0] and all("\ufffd" not in t and passage[100:400] not in t and set(t) <= set(docs[i]) for i, t in out.items() if i)


def plain_passages(docs, most_words=50):
    """(doc_id, start, size, words, n_chunks) of the runs, by sets of chunk bytes."""
    cut, held = {}, {}
    for i, t in docs:
        raw = t.encode()
        ends = chunks._whole(np.frombuffer(raw, np.uint8), chunks.cuts(np.frombuffer(raw, np.uint8)))
        cut[i] = [(a, b, sum(raw[p : p + 1].strip() != b"" and (p == 0 or raw[p - 1 : p].strip() == b"") for p in range(a, b))) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for a, b, _ in cut[i]:
            held.setdefault(raw[a:b], set()).add(i)
    out = []
    for i, t in docs:
        shared = [len(held[t.encode()[a:b]]) > 1 for a, b, _ in cut[i]]
        at = 0
        while at < len(shared):
            end = at
            while end < len(shared) and shared[end]:
                end += 1
            if end - at >= 2 and sum(w for *_, w in cut[i][max(0, at - 1) : end + 1]) > most_words - chunks.SLACK:
                out.append((i, cut[i][at][0], cut[i][end - 1][1] - cut[i][at][0], sum(w for *_, w in cut[i][at:end]), end - at))
            at = end + 1
    return sorted(out)


def test_passages_against_a_plain_version(spark):
    rng = random.Random(10)
    pool = [words(rng, rng.choice([10, 30, 44, 50, 51, 60, 90])) for _ in range(25)]
    docs = [(i, "\n".join([words(rng, rng.randint(0, 40)), *rng.sample(pool, rng.randint(0, 3)), words(rng, rng.randint(1, 40))])) for i in range(120)]
    out = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.size, r.words, r.n_chunks) for r in out) == plain_passages(docs)


def test_passages_of_just_over_fifty_words(spark):
    rng = random.Random(11)
    short = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6))) for _ in range(n))
    docs = []
    for k in range(300):
        p = short(51) if k < 200 else short(24)
        docs += [(2 * k + j, f"{short(30)} {p} {short(30)}") for j in (0, 1)]
    found = {r.doc_id for r in chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect()}
    assert len([i for i in found if i < 400]) >= 396 and len([i for i in found if i >= 400]) <= 4
