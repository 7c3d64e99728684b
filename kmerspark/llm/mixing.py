"""Mixing sources to target weights by fitting a word budget.

Each source gets a target number of words.  Documents are counted by source and
exact length; per source, whole passes over it and an even share of each length
use up most of the target, and a bounded-knapsack table over document lengths
fits what remains.  Its answer says how many documents of each length to take
once more; which ones is decided by a seeded hash of the row.

Only counts by length reach the knapsack: d distinct lengths need d * (d + 1) / 2
words, so a source of S words has fewer than sqrt(2 * S) of them.

Defined results: a null text has size 0; null sources form one source, the last;
sizes of 0 take no words; rows alike in every respect are told apart only by
place and may swap decisions; an empty table gives an empty table; columns
besides doc_id, text and source are not looked at, whatever their names.

The table is bounded and its result is not always the best there is: it trades
the TRIED shortest lengths that have documents left, up to TRADED documents of
each of the TRIED shortest taken lengths, and the NEAR lengths nearest to the
rest, at most COPIES documents of each, and tells MAX_SUMS sums apart.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.ranks import numbered_within, ranked, salt_of
from kmerspark.rows import MAX_BROADCAST, fresh, numbered
from kmerspark.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Pieces in which documents of one source and length are numbered.
SALTS = 1024
#: Sums that the knapsack table tells apart, and lengths that it tries.
MAX_SUMS = 1 << 21
TRIED = 48
#: Documents of one length that are handed back at most, and the words that all of them may have.
TRADED = 16
NEAR = 4
COPIES = 1 << 10
TRADED_WORDS = 1 << 19


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, no_src, source_size, target) from sizes(src, no_src, source_size).

    Weights repeat in the order of the sources' code points, null last.  The
    level per unit of weight is raised until the words that capped sources leave
    over are shared out; each round is one aggregate over the table of sources.
    """
    order = ranked(sizes, ["no_src", "src"], "nth")
    weighted = materialize(order.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))), "sources")
    cap = most * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = cap <= level * F.col("weight")
        r = weighted.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("n")).first()
        if not r.free or r.n == capped:
            break
        level, capped = (share * r["all"] - r.used) / r.free, r.n
    return weighted.select("src", "no_src", "source_size", F.least(cap, level * F.col("weight")).cast("double").alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take, counts at most, so that their sizes add up to nearly the budget."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    taken = np.floor(counts * min(1.0, budget / total)).astype(np.int64)
    left = budget - float((sizes * taken).sum())
    for i in np.argsort(-(counts * (budget / total) - taken), kind="stable"):  # largest remainders first
        if taken[i] < counts[i] and 0 < sizes[i] <= left:
            taken[i] += 1
            left -= sizes[i]
    usable = np.flatnonzero(sizes > 0)
    given = usable[taken[usable] > 0][:TRIED]  # some of the shortest are handed back, so that the table can trade them
    back = np.minimum(taken[given], np.minimum(TRADED, TRADED_WORDS // TRIED // sizes[given] + 1))
    taken[given] -= back
    left += float((sizes[given] * back).sum())
    open_ = usable[taken[usable] < counts[usable]]
    pool = np.unique(np.concatenate([open_[:TRIED], given, open_[np.argsort(np.abs(sizes[open_] - left), kind="stable")[:NEAR]]])).astype(np.int64)
    if not len(pool):
        return taken
    unit = max(1, (int(left) + int(sizes[pool].max())) // MAX_SUMS)
    goal, reach = int(round(left / unit)), (int(left) + int(sizes[pool].max())) // unit + 1
    parts, tables, mask, sums = [], [], (1 << (reach + 1)) - 1, 1
    for i in pool:
        n, step = int(min(counts[i] - taken[i], max(1, left // sizes[i] + 1), COPIES)), 1
        while n > 0:  # bounded counts as powers of two
            step_n = min(step, n)
            tables.append(sums)
            parts.append((int(i), step_n))
            sums |= (sums << (int(sizes[i]) // unit * step_n)) & mask
            n, step = n - step_n, step * 2
    below = (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = sums >> (goal + 1)
    at = below
    if above:
        first = goal + 1 + (above & -above).bit_length() - 1
        at = first if first - goal < goal - below else below
    for (i, n), table in zip(reversed(parts), reversed(tables), strict=True):
        if not table >> at & 1:
            taken[i] += n
            at -= int(sizes[i]) // unit * n
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // whole) if whole else 0
    extra = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), target - passes * whole)
    return pdf[["src", "no_src", "size", "source_size", "target"]].assign(passes=passes, extra=extra)


def _facts(seed: int) -> dict[str, Column]:
    """What a row is mixed by: its source, its size, and a key to choose by."""
    return {
        "src": F.coalesce("source", F.lit("")),
        "no_src": F.col("source").isNull(),
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "key": F.xxhash64(F.lit(seed), "doc_id", "text"),
    }


def _placed(sized: DataFrame, tie: str, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sized(src, no_src, size, key, tie) with source_size, target, passes, extra, _salt, and nth: the row's number in its source and size."""
    lengths = sized.groupBy("src", "no_src", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(sized.groupBy("src", "no_src").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = lengths.join(targets, ["src", "no_src"]).groupBy("src", "no_src").applyInPandas(_fit, "src string, no_src boolean, size long, source_size long, target double, passes int, extra long")
    salted = sized.withColumn("_salt", salt_of("key", salts=SALTS))
    return numbered_within(salted, ["src", "no_src", "size"], ["key", tie], "nth", facts=materialize(plan, "plan"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per row of docs(doc_id, text, source): size, source_size, target, copies, taken.

    copies: how often the mix takes the document; taken: its words in the mix.
    """
    sized = materialize(docs.select("doc_id", *[c.alias(n) for n, c in _facts(seed).items()]), "sized")
    copies = F.col("passes") + F.when(F.col("nth") < F.col("extra"), 1).otherwise(0)
    return _placed(sized, "doc_id", weights, share, most).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say, which no other row shares.

    Of each source and length the rows up to one place in the order of the keys
    are taken once more, so a row needs no more than that place to be judged.
    There is one for each length of a source, and they are broadcast up to
    MAX_BROADCAST of them; no text is shuffled.
    """
    facts = {n: fresh(f"_{n}", docs.columns) for n in ("src", "no_src", "size", "key", "last", "passes", "copy")}
    made = _facts(seed)
    kept, row = numbered(docs.withColumns({facts[n]: made[n] for n in made}))
    sized = kept.select(F.col(row).alias("row"), *[F.col(facts[n]).alias(n) for n in made])
    place = lambda salt, key, row: F.struct(salt.alias("salt"), key.alias("key"), row.alias("row"))
    placed = _placed(sized, "row", weights, share, most)
    at = F.when(F.col("nth") == F.col("extra") - 1, place(F.col("_salt"), F.col("key"), F.col("row")))
    plan = placed.groupBy("src", "no_src", "size").agg(F.max("passes").alias(facts["passes"]), F.max(at).alias(facts["last"]))
    plan = materialize(plan.select(*[F.col(n).alias(facts[n]) for n in ("src", "no_src", "size")], facts["passes"], facts["last"]), "places")
    few = plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = kept.join(F.broadcast(plan) if few else plan, [facts[n] for n in ("src", "no_src", "size")])
    own = place(salt_of(facts["key"], salts=SALTS), F.col(facts["key"]), F.col(row))
    copies = F.col(facts["passes"]) + F.when(own <= F.col(facts["last"]), 1).otherwise(0)
    return joined.where(copies > 0).withColumn(facts["copy"], F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
