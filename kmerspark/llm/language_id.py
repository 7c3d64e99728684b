"""Language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams,
trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net
penalties, then calibrated by a temperature.

Document frequencies are counted over the whole texts of all labelled documents
outside the held-out fold.  The weights are fitted on a bounded sample of them,
``per_language`` documents of each language at most; a fifth of it only sets the
temperature.  Every text is predicted whole.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text where there is nothing to learn from; a null doc_id counts
as the empty text for the folds and is not in the sample; rows that share doc_id
and lang are in the sample once; an empty table gives an empty table; columns
besides doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerspark.llm.sampling import held_out, sample_per_label, texts_of

#: Buckets that n-grams of 1 to ORDERS characters are hashed to.
DIM = 1 << 15
ORDERS = 3
PER_LANGUAGE = 500
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, 1 + log of their counts) of the text's n-grams; None without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    code = code[letter | np.concatenate(([True], letter[:-1]))]  # one space between words
    code = np.concatenate(([np.uint32(32)], code, [np.uint32(32)]))
    counts = np.zeros(DIM, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(DIM - 1), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = found
    x = tf * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with a letter, and for each bucket how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)  # the last counts texts
        for b in batches:
            for t in b.column(0):
                if (found := features(t.as_py())) is not None:
                    df[found[0]] += 1
                    df[DIM] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    counts = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1, np.int64)
    for r in counts.collect():  # DIM + 1 rows at most
        df[r.bucket] = r.n
    return int(df[DIM]), df[:DIM]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weights (classes, DIM)."""
    z, n = np.zeros((classes, DIM)), np.zeros((classes, DIM))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            za, na = z[:, at], n[:, at]
            w = weights(za, na)
            p = softmax(w @ x)
            p[y[i]] -= 1
            g = p[:, None] * x
            n_new = na + g * g
            z[:, at] = za + g - (np.sqrt(n_new) - np.sqrt(na)) / alpha * w
            n[:, at] = n_new
    return weights(z, n)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the labels likeliest, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model: languages, idf, weights and temperature."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total, df = document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    picked = sample_per_label(known, "lang", per_language)  # per_language rows of each language
    texts = texts_of(known, picked, ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, k, f) for i, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (f := features(t)) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], b.schema.field(0).type), pa.array([x[1] for x in found], pa.string()), pa.array([x[2][0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[2][1] for x in found], pa.list_(pa.float64()))], ["doc_id", "lang", "at", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {kind}, lang string, at array<int>, tf array<double>").collect()  # per_language rows of each language
    rows.sort(key=lambda r: (r.lang, str(r.doc_id), len(r["at"])))
    languages = sorted({r.lang for r in rows})
    x = [weighted((np.array(r["at"]), np.array(r.tf)), idf) for r in rows]
    y = np.array([languages.index(r.lang) for r in rows], dtype=np.int64)
    apart = np.arange(len(y)) % 5 == 4
    w = ftrl([v for v, a in zip(x, apart, strict=True) if not a], y[~apart], len(languages)) if languages else np.zeros((0, DIM))
    logits = np.array([w[:, at] @ v for (at, v), a in zip(x, apart, strict=True) if a]).reshape(int(apart.sum()), len(languages))
    return {"languages": languages, "idf": idf.astype(np.float32), "weights": np.ascontiguousarray(w.T.astype(np.float32)), "temperature": temperature(logits, y[apart])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x (languages + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for t in b.column(2):
                found = features(t.as_py()) if m["languages"] else None
                if found is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = weighted(found, m["idf"])
                p = softmax((x @ m["weights"][at]) / m["temperature"])
                k = int(p.argmax())
                names.append(m["languages"][k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on docs(doc_id, text, lang) and predict all of it."""
    return predict(docs, fit(docs, per_language))
