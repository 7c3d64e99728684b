"""Spelling variants of a corpus's own words: which are one edit apart, and which frequent form each belongs to.

Words are counted with partial sums.  The distinct ones form a trie that is held
as a table, a row for each node with two words or more below it; a node is named
by the letters that lead to it, and an edge to a single word carries all that is
left of it.  States (word, position, node, edits) are joined with the table level
by level: without an edit a state follows its own word, with a further letter it
takes another's edge (a replacement) or stays where it is (a deletion), and then
only what is spelled the same goes on.  A state that comes to a word's end with
one edit is a pair of neighbours.  Deletions of one word are insertions of the
other, and of two words that differ in a letter the lesser asks, so each pair is
found once.

An edit in the first half of a word would branch near the root, where all words
are.  So there are two tries, of the words and of the words read backwards, and
each is entered at the node half way, with edits in the other half alone.

Words of more than MOST letters do not go down the trie, whose levels they would
set: they meet under hashes of themselves less one letter, one row a letter, and
pairs are compared letter by letter.

Defined results: null and empty texts have no words; a null doc_id loses no
letter; repeated rows count again; ties for a form go to the least word in the
order of code points; an empty table gives an empty table; columns besides doc_id
and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.scratch import materialize

#: Letters that a word has at least, occurrences that it has at least, and how many times as frequent a form is.
LEAST, SEEN, TIMES = 7, 2, 10
#: One run in so many of a document loses a letter.
MISSPELT = 31
#: Letters of the longest word that goes down the trie.
MOST = 40
#: Distinct words that a task counts before it hands them back.
HELD = 500_000
_LOW = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: An odd number, as hashes are polynomials in it modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, least: int = LEAST, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n) of the runs of letters of docs(doc_id, text), less a letter where the run's checksum in its document says so; at least ``least`` letters are left."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # maximal ones, since a run is matched from its start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                head = crc32(f"{doc.as_py()}:".encode()) if doc.is_valid else None
                for word, n in Counter(runs.findall(text.as_py())).items():
                    word = word.lower() if word.isascii() else word.translate(_LOW)
                    if head is not None and not (h := crc32(word.encode(), head)) % misspelt:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.col("doc_id").cast("string"), "text").where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letter(text: str | Column, at: Column) -> Column:
    """The letter at a 0-based place; empty past the end."""
    return F.substring(text, at + 1, F.lit(1))


def _after(text: str | Column, at: Column) -> Column:
    """All from a 0-based place on."""
    return F.substring(text, at + 1, F.length(text))


def _read_both_ways(words: DataFrame) -> DataFrame:
    """(back, text, n, begin): each word forwards and backwards, with the depth at which its states begin; between them edits at every place are allowed once."""
    half = F.floor(F.length("word") / 2).cast("int")
    ways = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("text"), half.alias("begin")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("text"), (F.length("word") - half).alias("begin")))
    return words.select("n", F.explode(ways).alias("w")).select("w.back", "w.text", "n", "w.begin")


def trie_nodes(read: DataFrame, top: int) -> DataFrame:
    """(depth, back, node, kids) of the tries of read(back, text, n), from depth ``top`` on.

    Only nodes with at least two words below are rows.  kids: an edge for each
    next letter, empty for the word that ends here; rest and n are set where a
    single word lies that way: what of it is left from the node on, and its
    count.  A node has no more edges than there are letters, and one.
    """
    steps = read.select("back", "text", "n", F.explode(F.sequence(F.lit(top), F.length("text"))).alias("depth"))
    edges = steps.groupBy("depth", "back", F.substring("text", F.lit(1), F.col("depth")).alias("node"), _letter("text", F.col("depth")).alias("letter")).agg(F.count(F.lit(1)).alias("words"), F.min(F.struct("text", "n")).alias("one"))
    one = F.col("words") == 1
    kid = F.struct("letter", F.when(one, _after(F.col("one.text"), F.col("depth"))).alias("rest"), F.when(one, F.col("one.n")).alias("n"))
    return edges.groupBy("depth", "back", "node").agg(F.collect_list(kid).alias("kids"), F.sum("words").alias("words")).where("words > 1").drop("words")


#: A state of the frontier.
_STATE = ["back", "text", "n", "pos", "node", "edits"]


def _step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States one level further down; where one has come to a word, node is that word and found_n its count.

    edits = 0: a state stands at its own prefix.  It may lose its next letter,
    which is allowed at one end of a run of equal letters, so that no pair comes
    twice; the edge decides all else.
    """
    pos, text = F.col("pos"), F.col("text")
    in_run = F.when(F.col("back"), _letter(text, pos) == _letter(text, pos - 1)).otherwise(_letter(text, pos) == _letter(text, pos + 1))
    lose = F.when((F.col("edits") == 0) & (pos < F.length(text)) & ~in_run, F.array(F.struct(pos.alias("pos"), F.lit(0).alias("edits")), F.struct((pos + 1).alias("pos"), F.lit(1).alias("edits"))))
    both = states.select("back", "text", "n", "node", F.explode(F.coalesce(lose, F.array(F.struct("pos", "edits")))).alias("s")).select("back", "text", "n", "s.pos", "node", "s.edits")
    met = both.join(nodes, ["back", "node"]).select(*_STATE, F.explode("kids").alias("kid"))
    letter, rest, own = F.col("kid.letter"), F.col("kid.rest"), _letter(text, pos)
    replaced = (F.col("edits") == 0) & (letter > own) & (own != "")
    same = letter == own
    found = rest.isNotNull() & F.when(F.col("edits") == 1, rest == _after(text, pos)).otherwise(replaced & (_after(rest, F.lit(1)) == _after(text, pos + 1)))
    onward = rest.isNull() & (same | replaced)
    out = met.where(found | onward).withColumn("edits", F.when(replaced, 1).otherwise(F.col("edits")))
    return out.select("back", "text", "n", (pos + 1).alias("pos"), F.concat("node", F.coalesce(rest, letter)).alias("node"), "edits", F.col("kid.n").alias("found_n"))


def neighbours(words: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words(word, n) that differ by one inserted, deleted or replaced letter, once; words are distinct and have at least ``least`` letters."""
    short = materialize(_read_both_ways(words.where(F.length("word") <= most)), "words-both-ways")
    top = least // 2
    materialized = materialize(trie_nodes(short, top).repartition("depth", "back", "node"), "trie")
    last = materialized.agg(F.max("depth")).first()[0]
    begun = short.select("back", "text", "n", F.col("begin").alias("pos"), F.substring("text", F.lit(1), F.col("begin")).alias("node"), F.lit(0).alias("edits"))
    found, states = [], None
    for depth in range(top, last + 1) if last is not None else []:
        entering = begun.where(F.col("pos") == depth)
        states = entering if states is None else states.unionByName(entering)
        level = materialize(_step(states, materialized.where(F.col("depth") == depth).drop("depth")), "frontier")
        found.append(level.where("found_n IS NOT NULL"))
        states = level.where("found_n IS NULL").select(*_STATE)
    pairs = long_neighbours(words, most)
    forward = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    for level in found:
        pairs = pairs.unionByName(level.select(forward("text").alias("a"), F.col("n").alias("a_n"), forward("node").alias("b"), F.col("found_n").alias("b_n")))
    return pairs


def _letter_hashes(text: str) -> tuple[int, np.ndarray]:
    """The hash of a text, and of what is left of it without each of its letters, as signed numbers."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(code) - 1, _BASE))))
    sums = np.cumsum(code * power)
    whole = sums[-1] if len(sums) else np.uint64(0)
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    left = np.concatenate(([np.uint64(0)], sums[:-1])) + (whole - sums) * back
    return int(whole.astype(np.int64)), left.astype(np.int64)


def long_neighbours(words: DataFrame, most: int) -> DataFrame:
    """The pairs of neighbours() whose longer word has more than ``most`` letters.

    A key holds no more words than there are letters, as they agree on all but one.
    """
    long = materialize(words.where(F.length("word") >= most).withColumn("id", F.monotonically_increasing_id()), "long-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole, less = _letter_hashes(word)
                n, at = len(word), np.arange(len(word))
                ends = [i for i in range(n) if word[i : i + 1] != word[i + 1 : i + 2]] if n > most else []
                each = at if n > most else at[:0]
                parts = [("whole", [n], [-1], [whole]), ("lost", np.full(len(ends), n - 1), ends, less[ends] if ends else []), ("other", np.full(len(each), n), each, less[each])]
                for kind, length, place, key in parts:
                    if len(place):
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(place)), pa.array([kind] * len(place)), pa.array(length, pa.int64()), pa.array(place, pa.int64()), pa.array(key, pa.int64())], ["id", "kind", "length", "place", "key"])

    keys = materialize(long.select("id", "word").mapInArrow(run, "id long, kind string, length long, place long, key long"), "long-keys")
    of = lambda kind, name: keys.where(F.col("kind") == kind).select(F.col("id").alias(name), "length", "place", "key")
    lost = of("lost", "a").join(of("whole", "b").drop("place"), ["length", "key"]).select("a", "b", "place", F.lit(1).alias("off"))
    other = of("other", "a").join(of("other", "b"), ["length", "place", "key"]).where("a < b").select("a", "b", "place", F.lit(2).alias("off"))
    named = lambda c: long.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    met = lost.unionByName(other).join(named("a"), "a").join(named("b"), "b")
    head = lambda c: F.substring(c, F.lit(1), F.col("place").cast("int"))
    tail = lambda c, off: F.substring(c, F.col("place").cast("int") + off, F.length(c))
    equal = (head("a_word") == head("b_word")) & (tail("a_word", 2) == tail("b_word", F.col("off")))
    return met.where(equal).select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): forms followed to the last one, by as many joins as the logarithm of the longest way."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least: int = LEAST, seen: int = SEEN, times: int = TIMES, misspelt: int = MISSPELT, most: int = MOST) -> DataFrame:
    """One row per word of docs(doc_id, text) with at least ``seen`` occurrences: word, n, n_near, form, form_n, root.

    n_near counts the words one edit away; form is the most frequent of them, if
    it is ``times`` as frequent as the word; root is where forms lead in the end.
    """
    words = materialize(word_counts(docs, least, misspelt).where(F.col("n") >= seen), "words")
    pairs = neighbours(words, least, most)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("p")).select("p.*")
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= times * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    known = materialize(known, "forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


_RUNS = "[A-Za-zÀ-ÿ]{7,}"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same in SQL; checksums byte by byte over a table that the polynomial makes.
ORACLE = f"""WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, {_LOWER.format("run")} AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUNS}')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT w, c, list_transform(range(0, length(x) // 2), lambda j: CAST((instr('0123456789ABCDEF', substr(x, 2 * j + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * j + 2, 1)) - 1 AS BIGINT)) AS bytes FROM (SELECT w, c, hex(doc_id || ':' || w) AS x FROM r)),
h AS (SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, y: xor(a >> 8, t.t[CAST((xor(a, y) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM b, t),
d AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
v AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM d)),
p AS (SELECT v.word AS a, d.word AS b FROM v JOIN d ON v.less = d.word UNION SELECT d.word, v.word FROM v JOIN d ON v.less = d.word
 UNION SELECT x.word, y.word FROM v x JOIN v y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
q AS (SELECT a, b, d.n AS m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY d.n DESC, b) AS k FROM p JOIN d ON d.word = p.b),
f AS (SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * d.n THEN b END AS form, CASE WHEN m >= 10 * d.n THEN m END AS form_n FROM d LEFT JOIN q ON q.a = d.word AND k = 1),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, g.at AS root FROM f JOIN g ON g.word = f.word JOIN f AS e ON e.word = g.at WHERE e.form IS NULL"""
