"""Phrases against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from kmerspark.llm import collocations
from tests.llm import brute

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, percent=50, best=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", brute.lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        kept = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in kept.items()):
                continue
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus(rng):
    words = ["the", "The", "of", "a", "b", "é", "ß", "日本", "new", "york", "times", "x\x00y", "it's", "z z"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(n))
    rows = [(text(rng.randint(0, 300)), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("new york times " * 12, "en"), ("one two", "en"), (None, "en"), ("", None), (" \t.,", "fr"), ("rare phrase. " * 9, "fr"), ("good phrase. " * 10, "fr")]
    return rows + rows[:3] + [("the " + " the ".join(f"w{i % 40} v{i % 7}" for i in range(900)), "en")]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, n long, phrase string")


def test_against_a_plain_version(spark):
    rows = corpus(random.Random(3))
    want = plain(rows)
    assert len({r[0] for r in want}) == 4 and any(r[2].count(" ") == 2 for r in want)
    docs = frame(spark, rows)
    assert found(collocations.collocations(docs)) == want
    assert found(collocations.collocations(docs, hot=20)) == want  # most stripes in buckets
    assert found(collocations.collocations(docs, least=2, best=7)) == plain(rows, 2, best=7)


@pytest.mark.parametrize(("held", "merged", "chunk"), [(16, 8, 4), (1 << 22, 2, 1), (50, 1 << 19, 1 << 20)])
def test_stripes_by_the_batch(held, merged, chunk, monkeypatch):
    """However words are held, cut and merged, the stripes say the same."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rng, count = random.Random(held), Counter()
    hot, got, out = {("en", b"the"): 3}, [], []
    own = collocations._Stripes()
    for _ in range(40):
        words = [rng.choice([b"the", b"a", b"b", b"cc"]) for _ in range(rng.randint(1, 30))]
        for k in (1, 2, 3):
            count.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        for at in range(0, max(1, len(words) - 2), chunk):
            own.add(words[at : at + chunk + 2])
            own.taken.append(0 if at + chunk + 2 >= len(words) else -1)
            if own.full():
                got += own.stripes("en", hot)
                own = collocations._Stripes()
    got += own.stripes("en", hot)
    table = pa.Table.from_batches(got).sort_by([("word", "ascending"), ("bucket", "ascending")])
    table = table.append_column("parts", pa.array([hot.get(("en", w), 1) for w in table.column("word").to_pylist()], pa.int64()))
    out = collocations._merge(table, 5).to_pylist()
    sums, most = Counter(), Counter()
    for r in out:
        key = tuple(x for x in (r["first"], r["second"], r["third"]) if x is not None)
        sums[key] += r["n"]
        most[key] = max(most[key], r["most"])
    assert {k: v for k, v in sums.items() if v >= 5} == {k: v for k, v in count.items() if v >= 5}
    assert all(most[k] == max(v for q, v in count.items() if q[:2] == k and len(q) == 3) for k in sums if len(k) == 2 and sums[k] >= 5 and any(q[:2] == k for q in count if len(q) == 3))


def test_products_past_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**12 + 1, 4 * 10**12, 5 * 10**12)], "a long, l long, r long")
    score = df.select(collocations._score(df.a, df.l, df.r)).first()[0]
    assert score == 10**6 * (3 * 10**12 + 1) ** 2 // (4 * 10**12 * 5 * 10**12)


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("", "en"), ("a b", "en")])).count() == 0
