"""Sharding by Karmarkar-Karp differencing.

Texts that are equal form one indivisible group.  Groups of at least
1 / MAX_UNITS of all bytes stand alone, so there are at most MAX_UNITS of them;
the lighter ones are bundled by a hash into MAX_UNITS bundles, so no task gets
more than 2 * MAX_UNITS units, whatever the corpus.  Differencing starts with
one partial partition for each unit and repeatedly combines the two with the
largest spread, in opposite orders, until one is left.

Defined results: a null text counts as an empty one (size 1, CRC of nothing) and
is in its group; repeated rows are repeated; an empty table gives an empty
table; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kmerspark.ranks import numbered_within, salt_of
from kmerspark.scratch import materialize

MAX_UNITS = 32_768
#: Rows of one piece in which a shard is numbered.
PIECE = 100_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit."""
    if not sizes:
        return []
    # a partial partition: its sums from largest to smallest, and what it is made of
    heap = [(-s, i, [s] + [0] * (shards - 1), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made: dict[int, tuple] = {}  # node -> (left, right, where the left's and the right's places went)
    node = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=sums.__getitem__, reverse=True)
        went = [0] * shards
        for new, old in enumerate(order):
            went[old] = new
        least = sums[order[-1]]
        merged = [sums[i] - least for i in order]  # only differences matter
        made[node] = (left, right, went, went[::-1])
        heapq.heappush(heap, (-merged[0], node, merged, node))
        node += 1
    out = [0] * len(sizes)
    stack = [(heap[0][3], list(range(shards)))]
    while stack:
        at, place = stack.pop()
        if at < len(sizes):
            out[at] = place[0]
            continue
        left, right, went_a, went_b = made[at]
        stack += [(left, [place[i] for i in went_a]), (right, [place[i] for i in went_b])]
    return out


def _bundle() -> Column:
    return F.pmod(F.xxhash64("group"), F.lit(MAX_UNITS)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of docs(doc_id, text): size, text_crc32, law, shard, slot, grown_shard.

    slot: gapless from 0 in each shard.  The law is ``bytes``: sizes near equal.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialize(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")),
        "sizes",
    )
    groups = materialize(base.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = groups.where(F.col("bytes") * MAX_UNITS >= total)
    light = groups.where(F.col("bytes") * MAX_UNITS < total)
    units = heavy.select("group", F.lit(None).cast("int").alias("bundle"), "bytes").unionByName(light.groupBy(_bundle().alias("bundle")).agg(F.sum("bytes").alias("bytes")), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order in which rows arrive is not fixed; that of their values is
        pdf = pdf.assign(hex=[g.hex() if g is not None else "" for g in pdf["group"]]).sort_values(["bytes", "bundle", "hex"], ascending=False, ignore_index=True)
        return pdf.assign(shard=difference([int(x) for x in pdf["bytes"]], shards))[["group", "bundle", "shard"]]

    one = units.select("*", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "group binary, bundle int, shard int")  # at most 2 * MAX_UNITS rows
    dealt = materialize(one, "units")
    of_group = F.broadcast(dealt.where("bundle IS NULL").select("group", F.col("shard").alias("own")))
    of_bundle = F.broadcast(dealt.where("bundle IS NOT NULL").select(F.col("bundle"), F.col("shard").alias("bundled")))
    placed = base.withColumn("bundle", _bundle()).join(of_group, "group", "left").join(of_bundle, "bundle", "left")
    pieces = max(1, base.count() // PIECE)
    salted = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "bundled").alias("shard"), salt_of("doc_id", "text_crc32", salts=pieces).alias("_salt"))
    numbered = numbered_within(salted, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
