"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

from kmerspark.llm import variants
from tests.llm import brute

COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def near(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = brute.lower(w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(others), form[w], words.get(form[w])]
    for w in out:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    rows = df.collect()
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"] and len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def corpus(rng):
    """Words over few letters, so that many are near, of all lengths around the switch, and some frequent ones with their misspellings."""
    stems = ["".join(rng.choices("abàz", k=rng.randint(5, 12))) for _ in range(150)] + ["".join(rng.choices("ab", k=n)) for n in (13, 14, 15, 16, 90) for _ in range(3)]
    stems += ["aaaaaaa", "aaaaaaaa", "bbbbbbbbbb" * 5, "Überraschung", "a" * 14, "a" * 15, "a" * 16, "b" * 3000]
    words = list(stems)
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s) + 1)
            words.append(rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abàz") + s[i:], s[:i] + rng.choice("abz") + s[i + 1 :]]))
    rows = [(i, " ".join(rng.choices(words, k=40) + rng.choices(stems[:20], k=30)) + rng.choice([".", "\n", "9x×÷"])) for i in range(120)]
    return [*rows, (7, "Aaaaaaa aaaaaaa,AAAAAAAB"), (7, "Aaaaaaa aaaaaaa,AAAAAAAB"), (None, "ohnenummer ohnenummer ohnenumer ohnenumer"), (500, None), (501, ""), (502, "kurz")]


def test_against_a_plain_version(spark):
    rows = corpus(random.Random(11))
    want = plain(rows)
    assert sum(v[2] is not None for v in want.values()) > 50 and any(len(w) > 14 and v[1] for w, v in want.items())
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    for most in (14, 7):  # by the trie and by letters left out, nearly all by the latter
        assert found(variants.spelling_variants(docs, most=most)) == want


def test_chains_of_forms(spark):
    chain = {"abcdefg": 20_000, "abcdefgh": 2_000, "abcdefghi": 200, "abcdefghij": 20, "abcdefghijk": 2, "abcdefgx": 2_000}
    docs = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in chain.items()], "doc_id long, text string")
    got = found(variants.spelling_variants(docs))
    assert got == plain([(None, " ".join([w] * n)) for w, n in chain.items()])
    assert got["abcdefghijk"] == (2, 1, "abcdefghij", 20, "abcdefg")


def test_each_pair_once(spark):
    words = sorted({"aaaaaaaa", "aaaaaaa", "aabbaabb", "aabaabb", "aabbaab", "abbaabb", "aabbabb", "zabbaabb", "aabbaabz", "aaabbaabb"})
    pairs = [(r.a, r.b) for r in variants.neighbours(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_empty_tables(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")).count() == 0
