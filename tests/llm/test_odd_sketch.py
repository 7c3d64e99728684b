"""MinHash near-duplicates against a plain version."""

import random

import numpy as np

from kmerspark.llm import odd_sketch
from tests.llm import brute


def shingles(text):
    words = brute.WORD.findall(brute.lower(text))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def linked(a, b, percent=85):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(map(str, ((doc, len(sets[i]), least.get(find(i)), doc is not None and doc == least[find(i)]) for i, (doc, _) in enumerate(rows))))


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in df.collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words) + 1)
        kind = rng.random()
        words[i : i + (kind < 0.6)] = [] if kind < 0.3 else [f"new{rng.random()}"]
    return words


def corpus(rng):
    vocabulary = ["The", "the", "É", "日本", *(f"w{i}" for i in range(400))]
    rows, base = [], [rng.choices(vocabulary, k=n) for n in (6, 7, 8, 20, 60, 60, 200, 900)]
    for b in base:
        rows.append(b)
        for _ in range(14):
            rows.append(edited(rng, rng.choice(rows[-6:] if rng.random() < 0.5 else [b]), rng.randint(0, max(2, len(b) // 18))))
    rows = [(1000 - i, " ".join(w)) for i, w in enumerate(rows)]
    other = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "two one"), (2007, "one two three"), (None, "one  two\tthree"), (None, "nothing like it at all"), (2005, "one two"), (7, rows[3][1]), (8, "a " * 500), (9, "a " * 900)]
    return rows + other


def test_against_a_plain_version(spark):
    rows = corpus(random.Random(8))
    want = plain(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n long")
    assert found(odd_sketch.near_duplicates(docs)) == want
    assert found(odd_sketch.near_duplicates(docs, small=1, rounds=0)) == want  # by tiles alone
    assert odd_sketch.near_duplicates(docs.where("false")).count() == 0
    assert odd_sketch.near_duplicates(docs.where("text IS NULL")).count() == 1


def test_dense_groups(spark, monkeypatch):
    """Copies around the threshold of each other, and a group that shares most with them but is never linked; in several tiles."""
    monkeypatch.setattr(odd_sketch, "TILE", (40, 1 << 20))
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    far = edited(rng, base, 12)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 9)))) for i in range(250)] + [(1000 + i, " ".join(edited(rng, far, rng.randint(0, 2)))) for i in range(60)]
    got = found(odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows)


def test_sets_are_the_shingles():
    rng, known = random.Random(1), odd_sketch._Words()
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = " ".join(rng.choices(["a", "B", "b", "cc", "é"], k=n))
        assert len(odd_sketch.shingle_set(text.encode(), known)) == len(shingles(text))
    whole = odd_sketch.shingle_set(b"a b c d e f", known)
    assert len(np.intersect1d(whole, odd_sketch.shingle_set(b"x B c d E y", known))) == 2
    assert not np.intersect1d(odd_sketch.shingle_set(b"a b", known), odd_sketch.shingle_set(b"b a", known)).size


def test_sketches_keep_similar_pairs():
    """At the least similarity nearly all pairs share a band and none fails by its sketch; estimates follow the similarity."""
    rng = np.random.default_rng(5)
    bound, share, odd = odd_sketch.most_odd(), 0, {85: [], 60: [], 30: []}
    for percent, seen in odd.items():
        for _ in range(150):
            union = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            both, rest = 400 * percent // 100, 400 - 400 * percent // 100
            a, b = np.concatenate((union[:both], union[both : both + rest // 2])), np.concatenate((union[:both], union[both + rest // 2 :]))
            keys, sketch = odd_sketch.bands_and_sketches(np.stack([odd_sketch.samples_of(x) for x in (a, b)]))
            seen.append(int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum()))
            share += percent == 85 and bool((keys[0] == keys[1]).any())
    assert share == 150 and max(odd[85]) <= bound
    assert min(odd[60]) > bound and min(odd[30]) > max(odd[60])
    assert odd_sketch.most_odd(85, 256, 1e-3) < bound
