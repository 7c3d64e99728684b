"""Phrases of two and three words that stand together more often than their parts would, by stripes.

A task keeps, for each first word, a stripe: a counter of what follows it up to
the third word or the piece's end.  Stripes of one first word are merged
elementwise where they meet, and one merged stripe has everything about phrases
that begin with the word: the sum of its counters is the word's own frequency,
the sums over the second word are those of two-word phrases, the counters are
those of three-word phrases, and the largest counter under a second word is how
much of that phrase a single longer one takes up.

A word that begins more than HOT phrases has its stripe dealt to several buckets
by what follows, so no stripe outgrows a task; its sums are added up afterwards.
Words are counted first to know which those are.

Defined results: a null text is empty; a null lang counts as ``und``; repeated
rows count again; ties are ordered by phrase, byte by byte; an empty table gives
an empty table; columns besides text and lang are not looked at.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kmerspark.scratch import materialize

#: Occurrences of a candidate at least, percent of it that a longer phrase takes up, and phrases of a language that are returned.
LEAST, PERCENT, BEST = 10, 50, 2000
#: Words that a task holds before it hands its stripes back, and entries of stripes that are merged at once.
HELD, MERGED = 1 << 22, 1 << 19
#: Phrases that may begin with a word before its stripe is dealt to buckets, and hot words at most.
HOT, MOST_HOT = 1 << 21, 1_000_000
#: Words of a piece that are taken at once.
CHUNK = 1 << 20
_BITS = 21  # of a word's number among those of one batch
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b"\n" * len(_SEPARATORS))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text, in small letters."""
    return (words for piece in text.translate(_PLAIN).split(b"\n") if (words := piece.split()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, word, n) with the word as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "word", "n"])

        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = held.setdefault(lang, Counter())
                for words in _pieces(text.as_py()):
                    own.update(words)
                if sum(map(len, held.values())) >= HELD // 8:
                    yield counted()
                    held = {}
        if any(held.values()):
            yield counted()

    return _texts(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Stripes:
    """Words of one language as numbers, until their stripes are made."""

    def __init__(self) -> None:
        self.words, self.taken = {b"": 0}, array("q")

    def __len__(self) -> int:
        return len(self.taken)

    def full(self) -> bool:
        """Whether a further stretch may not fit."""
        return len(self.taken) >= HELD or len(self.words) + CHUNK + 2 >= 1 << _BITS

    def add(self, words: list[bytes]) -> None:
        """A stretch of a piece; 0 ends a piece, and -1 what goes on in the next stretch."""
        number = self.words
        self.taken.extend([number.setdefault(w, len(number)) for w in words])

    def stripes(self, lang: str, hot: dict[tuple[str, bytes], int]) -> Iterator[pa.RecordBatch]:
        taken = np.concatenate((np.frombuffer(self.taken, np.int64), [0, 0]))
        a, b, c = taken[:-2], taken[1:-1], taken[2:]
        c = np.where(b == 0, 0, c)
        own = (a > 0) & (b >= 0) & (c >= 0)
        entry, n = np.unique(a[own] << 2 * _BITS | b[own] << _BITS | c[own], return_counts=True)
        if not len(entry):
            return
        low = (1 << _BITS) - 1
        a, b, c = entry >> 2 * _BITS, entry >> _BITS & low, entry & low
        words = pa.array(list(self.words), pa.binary())
        buckets = np.ones(len(words), np.int64)
        for w, i in self.words.items():
            if (lang, w) in hot:
                buckets[i] = hot[lang, w]
        bucket = np.zeros(len(a), np.int64)
        many = np.flatnonzero(buckets[a] > 1)
        if len(many):
            sums = np.fromiter(map(crc32, self.words), np.int64, len(self.words))
            bucket[many] = (sums[b[many]] * 31 + sums[c[many]]) % buckets[a[many]]
            order = np.lexsort((bucket, a))
            a, b, c, n, bucket = a[order], b[order], c[order], n[order], bucket[order]
        begin = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1]))))
        for i in range(0, len(begin), 1 << 14):
            first = begin[i : i + (1 << 14)]
            end = begin[i + (1 << 14)] if i + (1 << 14) < len(begin) else len(a)
            s = slice(first[0], end)
            ends = np.append(first - first[0], end - first[0])
            both = pc.binary_join_element_wise(words.take(pa.array(b[s])), words.take(pa.array(c[s])), pa.scalar(b" ", pa.binary()))
            follow = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both), pa.scalar(b"\n", pa.binary()))
            counts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(n[s].astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), words.take(pa.array(a[first])), pa.array(bucket[first], pa.int32()), follow, counts], ["lang", "word", "bucket", "follow", "counts"])


def stripes(docs: DataFrame, hot: dict[tuple[str, bytes], int]) -> DataFrame:
    """(lang, word, bucket, follow, counts): the stripes of each task, of what follows a word: ``second third``, a line each, the third or both empty where the piece ends; hot: in how many buckets a word's stripe is dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = shared.value, {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for words in _pieces(text.as_py()):
                    for at in range(0, max(1, len(words) - 2), CHUNK):
                        own = held.setdefault(lang, _Stripes())
                        own.add(words[at : at + CHUNK + 2])
                        own.taken.append(0 if at + CHUNK + 2 >= len(words) else -1)
                        if own.full():
                            yield from held.pop(lang).stripes(lang, hot)
                if sum(map(len, held.values())) >= HELD:
                    for x, own in held.items():
                        yield from own.stripes(x, hot)
                    held = {}
        for x, own in held.items():
            yield from own.stripes(x, hot)

    return _texts(docs).mapInArrow(run, "lang string, word binary, bucket int, follow binary, counts binary")


def _sums(key: np.ndarray, n: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys with the sum of n, and the maximum of most."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    out = key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]
    return out if most is None else (*out, np.maximum.reduceat(most[order], first) if len(first) else most[:0])


def _merge(rows: pa.Table, least: int) -> pa.RecordBatch:
    """What whole stripes say: (lang, first, second, third, n, most), of words, two-word and three-word phrases; of one bucket of several its shares."""
    follow = rows.column("follow").combine_chunks()
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4").astype(np.int64)
    lists = pc.split_pattern(follow, b"\n")
    size = np.diff(lists.offsets.to_numpy())
    lang, word, bucket = (rows.column(c).combine_chunks() for c in ("lang", "word", "bucket"))
    key = pc.dictionary_encode(word).indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | pc.dictionary_encode(lang).indices.to_numpy(zero_copy_only=False)
    change = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket.to_numpy()[1:] != bucket.to_numpy()[:-1])))
    group, head = np.repeat(np.cumsum(change) - 1, size), np.flatnonzero(change)
    coded = pc.dictionary_encode(lists.flatten())
    # the counters
    key, n = _sums(group << 32 | coded.indices.to_numpy().astype(np.int64), counts)
    group, entry = key >> 32, key & 0xFFFFFFFF
    halves = pc.split_pattern(coded.dictionary, b" ", max_splits=1).flatten()
    second, third = halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2)))
    ends = pc.equal(third, pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)[entry]
    # by second word, and as a whole
    seconds = pc.dictionary_encode(second)
    of = seconds.indices.to_numpy().astype(np.int64)[entry]
    twos, two_n, two_most = _sums(group << 32 | of, n, np.where(ends, 0, n))
    ones, one_n = _sums(group, n)
    two_group, two_word = twos >> 32, twos & 0xFFFFFFFF
    shared = rows.column("parts").combine_chunks().to_numpy()[head] > 1
    real = pc.not_equal(seconds.dictionary, pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)
    three = (n >= least) & ~ends
    two = real[two_word] & ((two_n >= least) | shared[two_group])
    one = (one_n >= least) | shared[ones]
    g = np.concatenate((ones[one], two_group[two], group[three]))
    none = lambda m: pa.nulls(m, pa.binary())
    at = pa.array(head[g])
    columns = {
        "lang": lang.take(at),
        "first": word.take(at),
        "second": pa.concat_arrays([none(int(one.sum())), seconds.dictionary.take(pa.array(two_word[two])), second.take(pa.array(entry[three]))]),
        "third": pa.concat_arrays([none(int(one.sum() + two.sum())), third.take(pa.array(entry[three]))]),
        "n": pa.array(np.concatenate((one_n[one], two_n[two], n[three]))),
        "most": pa.array(np.concatenate((np.zeros(int(one.sum()), np.int64), two_most[two], np.zeros(int(three.sum()), np.int64)))),
    }
    return pa.RecordBatch.from_pydict(columns)


def merged(striped: DataFrame, hot: dict[tuple[str, bytes], int], least: int = LEAST) -> DataFrame:
    """(lang, first, second, third, n, most) of all words and phrases with at least ``least`` occurrences: second and third are null in shorter ones; most is the largest count of a phrase with one word more at the end."""
    shared = striped.sparkSession.sparkContext.broadcast(hot)
    ordered = striped.repartition("lang", "word", "bucket").sortWithinPartitions("lang", "word", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            parts = [hot.get(x, 1) for x in zip(t.column("lang").to_pylist(), t.column("word").to_pylist(), strict=True)]
            return _merge(t.append_column("parts", pa.array(parts, pa.int64())), least)

        held, bytes_ = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                same = np.flatnonzero(_changes(part, held[-1] if held else None))
                if bytes_ >= 12 * MERGED and len(same):
                    if cut := int(same[-1]):
                        held.append(part.slice(0, cut))
                    yield done(held)
                    held, bytes_, part = [], 0, part.slice(cut)
                held.append(part)
                bytes_ += int(pc.sum(pc.binary_length(part.column(3))).as_py() or 0)
        if held:
            yield done(held)

    rows = ordered.mapInArrow(run, "lang string, first binary, second binary, third binary, n long, most long")
    total = rows.groupBy("lang", "first", "second", "third").agg(F.sum("n").alias("n"), F.max("most").alias("most")).where(F.col("n") >= least)
    return total.select("lang", *[F.col(c).cast("string").alias(c) for c in ("first", "second", "third")], "n", "most")


def _changes(rows: pa.RecordBatch, last: pa.RecordBatch | None) -> np.ndarray:
    """Where a row's stripe is not that of the row before."""
    keys = [tuple(c) for c in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True)]
    before = tuple(last.column(i)[-1].as_py() for i in range(3)) if last is not None else None
    return np.array([x != y for x, y in zip(keys, [before, *keys[:-1]], strict=True)], bool)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10**6 a a / (l r)), of decimals, exactly."""
    d = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(1_000_000).cast("decimal(7,0)"), d(l) * d(r))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, best: int = BEST, hot: int = HOT) -> DataFrame:
    """The ``best`` phrases of each lang of docs(text, lang): lang, rank, phrase, a, l, r, n, score.

    Words are counted, and what begins with a hot word is known, when this is called.
    """
    words = materialize(word_totals(docs), "word-totals")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    least_hot = max(hot, (words.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    dealt = {(r.lang, bytes(r.word)): -(-2 * r.n // least_hot) for r in words.where(F.col("n") > least_hot).toLocalIterator()}
    found = materialize(merged(stripes(docs, dealt), dealt, least), "phrases")
    one = found.where("second IS NULL").select("lang", "first", "n")
    two = found.where("second IS NOT NULL AND third IS NULL").select("lang", "first", "second", "n", "most")
    three = found.where("third IS NOT NULL").select("lang", "first", "second", "third", F.col("n").alias("a"))

    def word(of: str, name: str) -> DataFrame:
        return one.select("lang", F.col("first").alias(of), F.col("n").alias(name))

    def pair(first: str, second: str, name: str) -> DataFrame:
        return two.select("lang", F.col("first").alias(first), F.col("second").alias(second), F.col("n").alias(name))

    before = three.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("before"))
    longer = F.greatest("most", F.coalesce("before", F.lit(0)))
    twos = two.withColumnRenamed("n", "a").join(before, ["lang", "first", "second"], "left").where((longer < least) | (100 * longer < percent * F.col("a")))
    twos = twos.join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    twos = twos.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.lit(1).alias("cut"), "l", "r").alias("low"))
    threes = three.join(word("first", "l1"), ["lang", "first"]).join(pair("second", "third", "r1"), ["lang", "second", "third"])
    threes = threes.join(pair("first", "second", "l2"), ["lang", "first", "second"]).join(word("third", "r2"), ["lang", "third"])
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    threes = threes.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", F.least(*cuts).alias("low"))
    scored = twos.unionByName(threes).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    return top.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same in SQL, with 128-bit products.
ORACLE = f"""WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM
 (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, length(w) + 1)) AS i FROM p)),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
u AS (SELECT lang, a, count(*) AS f FROM t GROUP BY ALL),
b AS (SELECT lang, a, b, count(*) AS f FROM t WHERE b IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, a, b, c, count(*) AS f FROM t WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT lang, a, b, max(f) AS m FROM (SELECT lang, a, b, f FROM c UNION ALL SELECT lang, b, c, f FROM c) GROUP BY ALL),
s AS (SELECT b.lang, b.a || ' ' || b.b AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k FROM b JOIN u x ON x.lang = b.lang AND x.a = b.a JOIN u y ON y.lang = b.lang AND y.a = b.b LEFT JOIN m ON m.lang = b.lang AND m.a = b.a AND m.b = b.b WHERE b.f >= 10 AND (m IS NULL OR 100 * m < 50 * b.f)
 UNION ALL SELECT c.lang, c.a || ' ' || c.b || ' ' || c.c, c.f, x.f, y.f, 1 FROM c JOIN u x ON x.lang = c.lang AND x.a = c.a JOIN b y ON y.lang = c.lang AND y.a = c.b AND y.b = c.c
 UNION ALL SELECT c.lang, c.a || ' ' || c.b || ' ' || c.c, c.f, x.f, y.f, 2 FROM c JOIN b x ON x.lang = c.lang AND x.a = c.a AND x.b = c.b JOIN u y ON y.lang = c.lang AND y.a = c.c),
d AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM s),
e AS (SELECT lang, phrase, a, l, r, score FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT f.lang, rank, phrase, a, l, r, n.n, score FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000"""
