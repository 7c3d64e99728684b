"""Quality rules under weak supervision.

Each rule looks at counts of one document and votes good, votes bad or, in
between, abstains.  How far a rule's votes can be trusted is not set by hand:
expectation-maximisation over the vote patterns of the whole corpus estimates,
for each rule, how often it votes good on good documents and on bad ones, and
the posterior probability of "good" replaces the demand that all rules pass: a
sign that the other rules' votes contradict often enough is outvoted by them.

Everything is built from DataFrame functions.  Documents meet the model only
through their vote pattern.  There are at most 3 ** len(RULES) patterns, so the
pattern table is small at any corpus size: EM runs over it inside one array
expression, and the posteriors are joined back by a broadcast of that bound.

Defined results: a null text counts as an empty one (all counts 0, base_failed);
an empty text fails the base; a row repeated in the input is repeated in the
output, and each row is judged by itself, also where doc_id is null or repeated;
an empty table gives an empty table; columns besides doc_id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.scratch import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A window's hash keeps its upper bits; the lower ones carry its place in the text.
PLACE_BITS = 30
ABSTAIN, GOOD, BAD = 0, 1, 2


def _share(n: str, of: str) -> Column:
    return F.col(n) / F.greatest(F.col(of), F.lit(1))


def rules() -> dict[str, Column]:
    """The rules, as columns over the counts of count_columns().

    Each looks at one sign of junk: it votes good well clear of it and bad where
    it is strong.
    """
    symbols, letters, bars = _share("n_symbols", "n_words"), _share("n_letters", "word_chars"), _share("n_bars", "n_words")
    capitals, bangs = _share("n_upper", "word_chars"), _share("n_bangs", "n_words")
    repeats, lines, length = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines"), _share("word_chars", "n_words")
    variety, line = _share("n_distinct", "n_words"), _share("n_words", "n_lines")
    signs = {
        "symbols": (symbols < 0.05, symbols > 0.25),
        "few_letters": (letters > 0.85, letters < 0.75),
        "bars": (bars < 0.03, bars > 0.15),
        "repeats": (repeats < 0.2, repeats > 0.4),
        "dup_lines": (lines < 0.1, lines > 0.3),
        "variety": (variety > 0.25, variety < 0.12),
        "capitals": (capitals < 0.12, capitals > 0.3),
        "shouting": (bangs < 0.1, bangs > 0.3),
        "word_length": (length.between(3, 12), (length < 2.5) | (length > 14)),
        "short_lines": (line >= 6, line < 2.5),
    }
    return {name: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for name, (good, bad) in signs.items()}


def count_columns(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The counts that the rules use, one row per input row, and the columns to keep, as the struct doc.

    Repeated three-word windows are found inside the row.  Places are sorted by
    the upper bits of their window's hash, as plain longs; only places whose bits
    meet again are compared as words, so the count is exact and costs little on
    text that does not repeat.
    """
    text = docs.select(F.struct(*keep).alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    split = text.select("doc", "t", F.array_remove(F.split("t", SPACE + "+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    counts = split.select(
        "doc",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"\P{L}", "")).cast("long").alias("n_letters"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        (F.length("t") - F.length(F.replace("t", F.lit("|"), F.lit("")))).cast("long").alias("n_bars"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.expr(f"IF(size(w) < 4, array(), sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), {PLACE_BITS}), {PLACE_BITS}) + i)))").alias("h"),
    )
    seen = counts.withColumn(
        "c",
        F.expr(f"filter(h, (x, i) -> (i > 0 AND shiftright(h[i - 1], {PLACE_BITS}) = shiftright(x, {PLACE_BITS})) OR (i < size(h) - 1 AND shiftright(h[i + 1], {PLACE_BITS}) = shiftright(x, {PLACE_BITS})))"),
    )
    windows = seen.withColumn("g", F.expr(f"sort_array(transform(c, x -> struct(concat_ws(' ', slice(w, CAST(x & {(1 << PLACE_BITS) - 1} AS INT) + 1, 3)) AS g, CAST(x & {(1 << PLACE_BITS) - 1} AS INT) AS p)))"))
    places = windows.withColumn("p", F.expr("sort_array(transform(filter(g, (x, i) -> (i > 0 AND g[i - 1].g = x.g) OR (i < size(g) - 1 AND g[i + 1].g = x.g)), x -> x.p))"))
    covered = F.expr("IF(size(p) = 0, 0, 3 + aggregate(transform(p, (x, i) -> IF(i = 0, 0, least(3, x - p[i - 1]))), 0, (a, x) -> a + x))")
    return places.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_letters", "n_bangs", "n_bars", "n_distinct")


def vote_pattern(counts: DataFrame) -> DataFrame:
    """counts with the column pattern: the votes as digits of a number to base 3."""
    return counts.withColumn("pattern", sum((v * 3**j for j, v in enumerate(rules().values())), F.lit(0)).cast("int"))


def posteriors(patterns: DataFrame, iterations: int = 40, prior: float = 0.5, on_good: float = 0.9, on_bad: float = 0.6, pseudo: float = 10.0) -> DataFrame:
    """(pattern, posterior) from (pattern, n), by expectation-maximisation.

    A rule that votes says good with one probability on good documents and with
    another on bad ones; whether it votes says nothing.  There are two, and not
    one accuracy, because junk shows few of the signs: most rules vote good on
    it too, and such votes must not count as much as a sign that good documents
    hardly ever show.  The state of one fold over 2 x iterations is the posterior
    of each pattern and the rules' probabilities; even steps re-estimate the
    first, odd steps the second.  ``pseudo`` votes at the starting values, on_good
    and on_bad, are added to each rule's.  The share of good documents is given,
    not fitted: fitted along with the rules, it drifts to one.
    """
    k = len(rules())
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n")))).alias("ps"))
    digits = lambda p: F.array(*[(F.floor(p["pattern"] / 3**j) % 3).cast("int") for j in range(k)])
    one = one.select(F.transform("ps", lambda p: F.struct(p["pattern"].alias("pattern"), p["n"].alias("n"), digits(p).alias("v"))).alias("ps"))
    which = F.sequence(F.lit(0), F.lit(k - 1))
    start = F.struct(F.transform("ps", lambda p: F.lit(0.0)).alias("q"), F.array(*[F.lit(on_good)] * k).alias("good"), F.array(*[F.lit(on_bad)] * k).alias("bad"))

    def expect(s: Column) -> Column:
        def log_odds(p: Column) -> Column:
            def vote(a: Column, j: Column) -> Column:
                v, good, bad = F.get(p["v"], j), F.get(s["good"], j), F.get(s["bad"], j)
                return a + F.when(v == GOOD, F.log(good / bad)).when(v == BAD, F.log((1 - good) / (1 - bad))).otherwise(0.0)

            return F.aggregate(which, F.lit(math.log(prior / (1 - prior))), vote)

        q = F.transform("ps", lambda p: 1 / (1 + F.exp(-log_odds(p))))
        return F.struct(q.alias("q"), s["good"].alias("good"), s["bad"].alias("bad"))

    def total(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)

    def maximise(s: Column) -> Column:
        def says_good(weight: Callable[[Column], Column], first: float) -> Column:
            def of(j: Column) -> Column:
                said = F.transform("ps", lambda p, i: F.when(F.get(p["v"], j) == GOOD, p["n"] * weight(i)).otherwise(0.0))
                voted = F.transform("ps", lambda p, i: F.when(F.get(p["v"], j) != ABSTAIN, p["n"] * weight(i)).otherwise(0.0))
                return (total(said) + pseudo * first) / (total(voted) + pseudo)

            return F.transform(which, of)

        return F.struct(s["q"].alias("q"), says_good(lambda i: F.get(s["q"], i), on_good).alias("good"), says_good(lambda i: 1 - F.get(s["q"], i), on_bad).alias("bad"))

    steps = F.sequence(F.lit(0), F.lit(2 * iterations))
    fitted = one.select("ps", F.aggregate(steps, start, lambda s, i: F.when(i % 2 == 0, expect(s)).otherwise(maximise(s))).alias("m"))
    return fitted.select(F.explode(F.arrays_zip(F.col("ps.pattern").alias("pattern"), F.col("m.q").alias("q"))).alias("x")).select(F.col("x.pattern").alias("pattern"), F.col("x.q").alias("posterior"))


def _judged(docs: DataFrame, keep: Sequence[str], threshold: float = 0.5, iterations: int = 40, min_words: int = 50) -> DataFrame:
    """The written counts of docs with base_failed, posterior and kept; the posteriors meet the rows by a broadcast."""
    counts = materialize(vote_pattern(count_columns(docs, keep)), "quality-counts", "zstd")
    model = posteriors(counts.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), iterations)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.join(F.broadcast(model), "pattern", "left")  # at most 3 ** len(rules()) rows
    return judged.withColumns({"base_failed": failed, "kept": ~failed & (F.col("posterior") >= threshold)})


def quality_rules(docs: DataFrame, threshold: float = 0.5, iterations: int = 40, min_words: int = 50) -> DataFrame:
    """One row per row of docs(doc_id, text): the counts, base_failed, posterior, kept.

    base_failed: fewer than min_words words, or over half of the words lie in
    repeated three-word windows.  kept: not base_failed, and the posterior
    probability of a good document is at least threshold.
    """
    judged = _judged(docs, ["doc_id"], threshold, iterations, min_words)
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rejected rows: each row carries its text along with its counts, so nothing is joined by an id."""
    return _judged(docs, docs.columns, **kw).where("kept").select("doc.*")
