"""Benchmark decontamination by exact n-grams, in DataFrame functions only.

The windows of the test items, normalised, are a hash set twice over: the hashes
of their first words, as longs, are broadcast, and the windows themselves are
joined to what those let through.  A document's words are cut into short blocks
that overlap by a window; each place of a block is looked up by the hash of its
first words, and only where that is found a window is built as a string and
verified by the join on the string.

The number of hashes is counted first.  Beyond MAX_BROADCAST of them places and
hashes meet in a shuffle of longs, and come back to the written blocks by their
number; what is verified, and the result, is the same.

Defined results: a null text has no words (0 words, 0 hits, 0 items, not
contaminated); an item without words has no window and an item shorter than the
window is one window of its own length; a null item_id counts as the empty
string; repeated input rows, and rows with a null or repeated doc_id, are judged,
returned and removed one by one; empty tables are allowed on either side; columns
besides the named ones are not looked at, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.rows import fresh, numbered, without_rows
from kmerspark.scratch import materialize

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Words at the head of a window, at most, that are hashed to find candidates.
ANCHOR = 4
#: Places of a block.
BLOCK = 32
#: Hashes that are broadcast at most.
MAX_BROADCAST = 2_000_000


def ascii_lower(text: str) -> Column:
    """A-Z lowered and every other character kept."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN_WORDS), "")


def _anchor(words: str, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(n)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, len, n_anchor, anchor, items): each distinct window of items(item_id, text) and the ids that hold it."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("w")).where(F.size("w") > 0)
    sized = split.withColumn("len", F.least(F.lit(window), F.size("w")))
    places = sized.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("b"))
    anchor = F.lit(None).cast("long")
    for n in range(1, ANCHOR + 1):
        anchor = F.when(F.least("len", F.lit(ANCHOR)) == n, _anchor("b", F.lit(0), n)).otherwise(anchor)
    grams = places.select("item", "len", F.array_join("b", " ").alias("gram"), F.least("len", F.lit(ANCHOR)).alias("n_anchor"), anchor.alias("anchor"))
    return grams.groupBy("gram", "len", "n_anchor", "anchor").agg(F.collect_set("item").alias("items"))


def _places(docs: DataFrame, sizes: list[int], window: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (row, doc_id, n_words, at, b) of docs(row, doc_id, text), and of each block its places (i, n_anchor, anchor).

    A document has one more place, -1, without a hash, so that it stays when none of its words is looked at again.
    """
    split = docs.select("row", "doc_id", words_of("text").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = split.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, F.lit(BLOCK + window - 1)).alias("b")))).alias("x")).select("row", "doc_id", "n_words", "x.at", "x.b")
    return blocks, F.explode(F.sequence(F.when(F.col("at") == 0, -1).otherwise(0), F.least(F.size("b"), F.lit(BLOCK)) - 1))


def _hashed(placed: DataFrame, sizes: list[int]) -> DataFrame:
    hashes = [F.struct(F.lit(n).alias("n_anchor"), F.when(F.col("i") >= 0, _anchor("b", F.col("i"), n)).alias("anchor")) for n in sizes]
    return placed.select("*", (hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))).alias("h")).select(*placed.columns, "h.n_anchor", "h.anchor")


def _candidates(docs: DataFrame, grams: DataFrame, window: int, max_broadcast: int) -> DataFrame:
    """(row, doc_id, n_words, i, len, gram): windows of docs(row, doc_id, text) that start like a test window, and for each row one with i < 0."""
    sizes = sorted(r.n_anchor for r in grams.select("n_anchor").distinct().collect())  # ANCHOR rows at most
    anchors = grams.select("anchor", "n_anchor", "len").distinct()
    blocks, places = _places(docs, sizes, window)
    wanted = (F.col("i") < 0) | (F.col("i") + F.col("len") <= F.size("b"))
    gram = F.when(F.col("i") >= 0, F.array_join(F.slice("b", F.col("i") + 1, F.col("len")), " "))
    if not sizes:
        return blocks.where("at = 0").select("row", "doc_id", "n_words", F.lit(-1).alias("i"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("gram"))
    if anchors.count() <= max_broadcast:
        hashed = _hashed(blocks.select("*", places.alias("i")), sizes)
        # the left join keeps the place -1, once for each size; it is not looked at again but for the first
        found = hashed.join(F.broadcast(anchors), ["anchor", "n_anchor"], "left").where(F.when(F.col("i") < 0, F.col("n_anchor") == sizes[0]).otherwise(F.col("len").isNotNull()))
    else:
        kept, block = numbered(blocks)
        hashed = _hashed(kept.select(block, "b", places.alias("i")), sizes).where("i >= 0").select(block, "i", "n_anchor", "anchor")
        met = hashed.join(anchors, ["anchor", "n_anchor"]).select(block, "i", "len")
        first = kept.where("at = 0").select(block, F.lit(-1).alias("i"), F.lit(None).cast("int").alias("len"))
        found = kept.join(met.unionByName(first), block)
    return found.where(wanted).select("row", "doc_id", "n_words", F.when(F.col("i") < 0, -1).otherwise(F.col("at") + F.col("i")).alias("i"), "len", gram.alias("gram"))


def _hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """hits() of docs(row, doc_id, text), with the column row; row tells the rows apart."""
    grams = materialize(item_windows(items, window), "grams")
    found = materialize(_candidates(docs, grams, window, max_broadcast), "windows")
    verified = found.where("i >= 0").join(grams.select("gram", "len", "items"), ["gram", "len"])
    per_row = verified.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "len"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("aggregate(spans, named_struct('upto', 0, 'n', 0L), (a, x) -> named_struct('upto', greatest(a.upto, x.i + x.len), 'n', a.n + greatest(0, x.i + x.len - greatest(x.i, a.upto))), a -> a.n)")
    rows = found.where("i < 0").select("row", "doc_id", "n_words").join(per_row, "row", "left")
    none = F.array().cast("array<struct<i:int,len:int>>")
    filled = rows.withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return filled.select("row", "doc_id", "n_words", covered.alias("n_hit"), "spans", "items")


def hits(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_hit, spans, items.

    spans: the occurrences of test windows as (i, len) in words, sorted; n_hit:
    words inside any of them; items: ids of the items that occur, sorted as strings.
    """
    return _hits(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), items, **kw).drop("row")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontamination_report(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The verdict on each document, with a digest of the items found in it."""
    return hits(docs, items, **kw).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def _own(docs: DataFrame, row: str) -> DataFrame:
    return docs.select(F.col(row).alias("row"), "doc_id", "text")


def remove_documents(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """docs without the contaminated rows; each row is judged by itself."""
    kept, row = numbered(docs)
    bad = _hits(_own(kept, row), items, **kw).where(is_contaminated()).select(F.col("row").alias(row))
    return without_rows(kept, bad, row).select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """docs(doc_id, text, ...) with the words of test windows cut out of the text, each with the separator before it."""
    kept, row = numbered(docs)
    spans, pieces, keep = (fresh(n, kept.columns) for n in ("_spans", "_pieces", "_keep"))
    found = _hits(_own(kept, row), items, **kw).where(F.col("n_hit") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans))
    word = BETWEEN_WORDS.replace("[", "[^").replace("+", "")
    cut = kept.join(found, row, "left").withColumn(pieces, F.when(F.col(spans).isNotNull(), F.regexp_extract_all("text", F.lit(f"{BETWEEN_WORDS.replace('+', '*')}{word}+"), F.lit(0))))
    hit = F.flatten(F.transform(spans, lambda x: F.sequence(x["i"] + 1, x["i"] + x["len"])))
    cut = cut.withColumn(keep, F.when(F.col(spans).isNotNull(), F.array_except(F.sequence(F.lit(1), F.size(pieces)), hit)))
    left = F.array_join(F.transform(keep, lambda i: F.element_at(pieces, i)), "")
    return cut.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: The report by SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM
  (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, g.item_id FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
