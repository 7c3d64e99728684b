"""Toxicity by subword-bag embeddings.

A text is cut into segments of SEGMENT words.  A segment is the average of the
embeddings of its distinct words and of their distinct character n-grams, hashed
to buckets and filled up to FLOOR with zero vectors (else one word said over and
over would weigh as much as a segment full of them), put through a linear
softmax; embeddings and softmax are trained jointly in numpy.  Words never seen
share the vectors of the n-grams that they have in common with those that were,
so misspellings and inflections are recognised.  A document's score
is its worst segment's, so that the length of a document does not dilute it.

Labels are of documents.  Training starts on whole documents, each one bag of
its distinct n-grams, which finds the n-grams that toxic documents have in
common; later passes are over segments, and of a toxic document they use those
that the model of the pass before finds the worst.  It uses a bounded sample: ``per_label`` documents of each
label at most, and of a clean document at most ``clean_segments`` segments.  A
fifth of the sample, with all its segments, only sets the slope and the offset
that turn a document's log-odds into a probability, with some labels taken to be
wrong.  Every text is scored whole.

Defined results: an empty or null text, and one without a letter or digit, has
the score of a clean segment without n-grams (0); labels of null are not used,
and of several labels of a doc_id the greatest is; of rows that share a doc_id
one is learned from, and all are scored;
without both labels to learn from all scores are 0; an empty table gives an
empty table; columns besides doc_id, text and toxic are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerspark.llm.sampling import held_out, sample_per_label, texts_of

BUCKETS = 1 << 18
ORDERS = (3, 4, 5, 6)
WIDTH = 8
SEGMENT = 8
#: Words and n-grams that a segment is averaged over at least.
FLOOR = 70
#: What an embedding loses in a step that uses it.
DECAY = 3e-4
PER_LABEL = 1500
CLEAN_SEGMENTS = 32
THRESHOLD = 0.7


@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, segment) of every distinct word and n-gram of each segment, in order, and the number of segments.

    N-grams lie inside words, with a space for either end of the word.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word_characters()[code]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    code = np.where(word, code, np.uint32(32))
    code = code[word | np.concatenate(([True], word[:-1]))]  # one space between words
    code = np.concatenate(([np.uint32(32)], code[1:] if code[0] == 32 else code, [np.uint32(32)]))
    space = code == 32
    segment = (np.cumsum(space) - 1) // SEGMENT
    inner = np.concatenate(([0], np.cumsum(space)))
    h = code * np.uint32(0x9E3779B1)
    buckets, segments = [], []
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if n in ORDERS:
            m = len(h)
            whole = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]  # no space but at the ends
            buckets.append(h[whole] & np.uint32(BUCKETS - 1))
            segments.append(segment[:m][whole])
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # of every word
    inside = np.arange(len(code)) - np.maximum.accumulate(np.where(space, np.arange(len(code)), 0))
    h = (code * np.uint32(0x9E3779B1) ^ inside.astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    h = np.add.reduceat(np.where(space, np.uint32(0), h ^ h >> np.uint32(15)), first, dtype=np.uint32) * np.uint32(0x9E3779B1)
    buckets.append((h ^ h >> np.uint32(13)) & np.uint32(BUCKETS - 1))
    segments.append(segment[first])
    key = np.sort(np.concatenate(segments) * BUCKETS + np.concatenate(buckets))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key % BUCKETS, key // BUCKETS, int(segment[-1]) + 1


def _segments(text: str | None) -> list[np.ndarray]:
    """The buckets of each segment that has any."""
    bucket, segment, _ = subwords(text)
    ends = np.flatnonzero(np.diff(segment)) + 1
    return np.split(bucket.astype(np.int32), ends) if len(bucket) else []


class Bags:
    """Averaged embeddings and a linear softmax of two classes, with per-cell step sizes (Adagrad)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.v = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.u = rng.normal(0, 1 / WIDTH, (WIDTH, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.v2, self.u2, self.b2 = np.full(BUCKETS, 1e-3, np.float32), np.full((WIDTH, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)

    def step(self, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, rate: float) -> None:
        starts = np.cumsum(sizes) - sizes
        over = np.maximum(sizes, FLOOR)[:, None]  # filled up with zero vectors
        mean = np.add.reduceat(self.v[flat], starts) / over
        s = mean @ self.u + self.b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g_u, g_b = mean.T @ p, p.sum(axis=0)
        g_mean = (p @ self.u.T) / over
        used, at = np.unique(flat, return_inverse=True)
        each = np.repeat(g_mean, sizes, axis=0)
        g_v = np.stack([np.bincount(at, weights=each[:, k], minlength=len(used)) for k in range(WIDTH)], axis=1)
        self.v2[used] += (g_v**2).mean(axis=1)
        self.v[used] = (1 - DECAY) * self.v[used] - rate * g_v / np.sqrt(self.v2[used])[:, None]
        self.u2 += g_u**2
        self.b2 += g_b**2
        self.u -= rate * g_u / np.sqrt(self.u2)
        self.b -= rate * g_b / np.sqrt(self.b2)

    def table(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of toxic in an average, and the bias."""
        return self.v @ (self.u[:, 1] - self.u[:, 0]), float(self.b[1] - self.b[0])


def train(toxic: list[list[np.ndarray]], clean: list[list[np.ndarray]], warm: int = 12, passes: int = 8, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """table() of a model for the segments of toxic and of clean documents."""
    model = Bags()

    def go(bags: list[np.ndarray], y: np.ndarray, batch: int) -> None:
        order = model.rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            model.step(np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]), y[own], rate)

    whole = [np.unique(np.concatenate(d)) for d in [*toxic, *clean]]
    for _ in range(warm):
        go(whole, np.array([1] * len(toxic) + [0] * len(clean)), 16)
    segments = [s for d in clean for s in d]
    for n in range(passes):
        add, bias = model.table()
        worst = []
        for doc in toxic:
            means = np.array([add[s].sum() / max(len(s), FLOOR) for s in doc])
            worst += [doc[i] for i in np.flatnonzero((means == means.max()) | ((means + bias > 2) if n else False))]
        bags = worst + segments
        go(bags, np.array([1] * len(worst) + [0] * len(segments)), max(64, len(bags) // 300))
    return model.table()


def worst_segment(bags: list[np.ndarray], add: np.ndarray, bias: float) -> float:
    return max(float(add[s].sum()) / max(len(s), FLOOR) for s in bags) + bias


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of log-odds x that make the labels likeliest, if a share of either label is wrong.

    The shares and the labels meant are estimated in turn, with a Newton step
    each round; a few wrong labels far off would flatten a plain logistic curve.
    """
    if not (0 < y.sum() < len(y)):
        return 1.0, 0.0
    scale = max(float(x.std()), 1e-6)
    z = np.stack([x / scale, np.ones_like(x)])
    w, start, ridge = np.array([4.0, -2.0]), np.array([1.0, 0.0]), np.diag([1e-2, 1e-3])
    missed = false = 0.02
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -35, 35)))
        one = p * np.where(y == 1, 1 - missed, missed)
        t = one / (one + (1 - p) * np.where(y == 1, false, 1 - false))
        missed = (t[y == 0].sum() + 0.5) / (t.sum() + 10)
        false = ((1 - t)[y == 1].sum() + 0.5) / ((1 - t).sum() + 10)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)) @ z.T + ridge, z @ (p - t) + ridge @ (w - start))
        w = w - np.clip(step, -1, 1)
        w[0] = max(w[0], 1e-2)
    return float(w[0]) / scale, float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, clean_segments: int = CLEAN_SEGMENTS) -> dict | None:
    """The model, from docs(doc_id, text) and labels(doc_id, toxic); None where a label is missing."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sample_per_label(known, "toxic", per_label)
    texts = texts_of(docs, picked, ["doc_id"])

    def apart(doc_id: object) -> bool:
        return zlib.crc32(f"apart {doc_id}".encode()) % 5 == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = _segments(text)
                if toxic != 1 and not apart(doc_id) and len(own) > clean_segments:
                    own = [own[i] for i in np.linspace(0, len(own) - 1, clean_segments).astype(int)]
                if own:
                    rows.append((doc_id, toxic, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "bags"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(run, f"doc_id {kind}, toxic int, bags array<array<int>>")
    rows = []
    for r in found.toLocalIterator():  # per_label rows of each label
        rows.append((r.toxic, str(r.doc_id), [np.array(s, np.int32) for s in r.bags]))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    toxic, clean = ([r[2] for r in rows if (r[0] == 1) == k and not apart(r[1])] for k in (True, False))
    if not toxic or not clean:
        return None
    add, bias = train(toxic, clean)
    own = [r for r in rows if apart(r[1])]
    slope, offset = calibrate(np.array([worst_segment(r[2], add, bias) for r in own]), np.array([int(r[0] == 1) for r in own]))
    return {"add": (add * slope).astype(np.float32), "bias": bias * slope + offset}


def log_odds(text: str | None, add: np.ndarray, bias: float) -> float:
    """Of the text's worst segment; minus infinity without n-grams."""
    bucket, segment, n = subwords(text)
    if not len(bucket):
        return -np.inf
    size = np.bincount(segment, minlength=n)
    total = np.bincount(segment, weights=add[bucket], minlength=n)
    return float((total[size > 0] / np.maximum(size[size > 0], FLOOR)).max()) + bias


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            odds = np.array([log_odds(t.as_py(), m["add"], m["bias"]) if m else -np.inf for t in b.column(2)], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            p[np.isneginf(odds)] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of docs and score all of it."""
    return score(docs, fit(docs, labels))
