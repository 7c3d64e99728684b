"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over a text's bytes, and the text is cut where the hash
is the least of all within REACH bytes on either side.  Where a chunk ends so
depends on the bytes around and not on their place in the text or on earlier
cuts: an insertion moves the cuts next to it and no others.  Chunks are
deduplicated by digest.  What is reported, and removed, is a run of chunks
next to each other that all occur in more than one document, if a passage of over
MOST_WORDS words may lie there.  Such a passage mostly ends inside the chunks next
to the run, so their words count for the decision, though they are not reported;
SLACK words may still lie beyond them.  Where a passage ends is not looked up, so
shared runs a little shorter are reported too.  Lone short chunks that happen to
recur are left alone.

Only a digest, the document and a place go through the shuffle, first reduced by
partial aggregates, so a chunk that a third of all documents share is one row
per task when it reaches its reducer; its documents meet it by a broadcast of the
hot chunks.  A run needs at least two chunks, so one
meeting of two 64-bit digests by chance reports nothing.

Defined results: null and empty texts have no chunks; repeats inside one
document alone are not reported; a null doc_id takes no part; rows that share a
doc_id are one document; an empty table gives an empty table; columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from kmerspark.rows import fresh, meet, numbered
from kmerspark.scratch import materialize

#: Bytes of the hash's window, bytes on either side in which a cut's hash is the least, and the most bytes of a chunk.
#: Chunks have over REACH bytes, about twice that on average.
SPAN = 8
REACH = 20
MOST = 256
#: A passage of more words is to be found, and so many of its words may lie beyond the chunks next to its run.
MOST_WORDS = 50
SLACK = 4
#: The gear table: a random number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A chunk has fewer words than 1 << WORDS_BITS.
WORDS_BITS = 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = the sum of GEAR[data[i - j]] << j over the SPAN bytes up to i, by doubling the span."""
    h = GEAR[data]
    n = 1
    while n < SPAN:
        shifted = np.zeros_like(h)
        shifted[n:] = h[:-n] << np.uint32(n)
        h = h + shifted
        n *= 2
    return h


def _least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of h[i : i + n] for every i, by doubling; past the end counts as large."""
    out, width = np.concatenate((h, np.full(n, np.iinfo(h.dtype).max, h.dtype))), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out[: len(h)]


def cuts(data: np.ndarray) -> list[int]:
    """Where chunks of these bytes end.  Of equal hashes the first counts as the least."""
    n = len(data)
    # 64 bits: the hash, then its place as the tie-break
    h = (gear_hash(data).astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    ahead = _least_of(h, 2 * REACH + 1)
    places = np.flatnonzero(ahead[: max(0, n - 2 * REACH)] == h[REACH : max(REACH, n - REACH)]) + REACH + 1
    ends, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > MOST:  # bytes that only repeat
            at += MOST
            ends.append(at)
        if p > at:
            ends.append(p)
            at = p
    return ends


def _whole(data: np.ndarray, ends: list[int]) -> list[int]:
    """ends, moved on to where a character of the UTF-8 text begins."""
    out = np.array(ends)
    for _ in range(3):
        out += (out < len(data)) & (data[np.minimum(out, len(data) - 1)] & 0xC0 == 0x80)
    return np.unique(out).tolist()


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, idx, start, size, words, digest) of every chunk; row tells rows of docs apart.

    words holds three numbers: the words that begin in the chunk, in the one before and in the one after it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            counts, parts = np.zeros(len(texts), np.int64), []
            for k, text in enumerate(texts):
                raw = text.encode("utf-8", "surrogatepass")
                if not raw:
                    continue
                data = np.frombuffer(raw, np.uint8)
                ends = _whole(data, cuts(data))
                starts = [0, *ends[:-1]]
                space = _SPACE[data]
                heads = ~space
                heads[1:] &= space[:-1]
                digest = xxhash.xxh3_64_intdigest
                hashes = np.array([digest(raw[i:j]) for i, j in zip(starts, ends, strict=True)], np.uint64).view(np.int64)
                own = np.add.reduceat(heads, starts, dtype=np.int32)
                words = own | np.concatenate(([0], own[:-1])).astype(np.int32) << WORDS_BITS | np.concatenate((own[1:], [0])).astype(np.int32) << 2 * WORDS_BITS
                parts.append((np.arange(len(ends), dtype=np.int32), np.array(starts, np.int32), np.diff([0, *ends]).astype(np.int32), words, hashes))
                counts[k] = len(ends)
            if not parts:
                continue
            which = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))], ["doc_id", "row", "idx", "start", "size", "words", "digest"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row long, idx int, start int, size int, words int, digest long")


def _words(of: int):
    """The words of the chunk itself (0), of the one before (1) or of the one after (2)."""
    return F.shiftright("words", of * WORDS_BITS).bitwiseAND((1 << WORDS_BITS) - 1)


def _passages(docs: DataFrame, most_words: int) -> DataFrame:
    """repeated_passages() of docs(row, doc_id, text), with the column row."""
    chunks = materialize(chunked(docs), "chunks")
    seen = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first_doc_id <> last").drop("last")
    shared = meet(chunks, materialize(seen, "shared-chunks"), ["digest"], "n").drop("digest", "n")
    place = W.partitionBy("row").orderBy("idx")
    turns = F.coalesce(F.lag("first_doc_id").over(place) != F.col("first_doc_id"), F.lit(False)).cast("int")
    islands = shared.withColumns({"island": F.col("idx") - F.row_number().over(place), "turn": turns})
    parts = islands.withColumn("part", F.sum("turn").over(place.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("row", "doc_id", "island", "part", "first_doc_id").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.sum(_words(0)).alias("words"), F.count(F.lit(1)).alias("n_chunks"), F.min_by(_words(1), "idx").alias("before"), F.max_by(_words(2), "idx").alias("after")
    )
    runs = parts.groupBy("row", "doc_id", "island").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("words").alias("words"), F.sum("n_chunks").alias("n_chunks"),
        F.min_by("first_doc_id", "part").alias("first_doc_id"), F.bool_and(F.col("first_doc_id") == F.col("doc_id")).alias("is_first"),
        F.sort_array(F.collect_list(F.struct("start", "size", "words", "n_chunks", "first_doc_id"))).alias("parts"),
        (F.min_by("before", "part") + F.max_by("after", "part")).alias("around"),
    )
    return runs.where((F.col("words") + F.col("around") > most_words - SLACK) & (F.col("n_chunks") >= 2)).select("row", "doc_id", "start", "size", "words", "n_chunks", "first_doc_id", "is_first", "parts")


def repeated_passages(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per run of chunks, in docs(doc_id, text), that other documents hold too.

    doc_id, start and size (bytes of the UTF-8 text), words, n_chunks, and
    first_doc_id: the smallest doc_id with the run's first chunk, or this one's
    own where it is the first itself; is_first says so for the whole run.  parts
    tells the run apart, in order, wherever the first document of its chunks
    changes: start, size, words, n_chunks and first_doc_id, for all its chunks.
    """
    return _passages(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), most_words).drop("row")


def remove_repeats(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) without repeated passages that a smaller doc_id holds first; a chunk stays where it is first.

    Each row loses its own passages; rows that share a doc_id are one document and lose nothing to each other.
    """
    kept, row = numbered(docs)
    spans, raw, gaps = (fresh(n, kept.columns) for n in ("_spans", "_raw", "_gaps"))
    found = _passages(kept.select(F.col(row).alias("row"), "doc_id", "text"), most_words).select("row", "doc_id", F.inline("parts")).where("first_doc_id <> doc_id")
    found = found.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias(spans))
    # what lies between the spans, and after the last
    joined = kept.join(found, row, "left").withColumn(raw, F.col("text").cast("binary"))
    joined = joined.withColumn(gaps, F.expr(f"transform({spans}, (s, i) -> struct(IF(i = 0, 0, {spans}[i - 1].start + {spans}[i - 1].size) AS a, s.start AS b))"))
    left = F.expr(f"decode(concat(aggregate({gaps}, CAST('' AS BINARY), (acc, g) -> concat(acc, substring({raw}, CAST(g.a AS INT) + 1, CAST(g.b - g.a AS INT)))), substring({raw}, CAST(element_at({spans}, -1).start + element_at({spans}, -1).size AS INT) + 1)), 'UTF-8')")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
