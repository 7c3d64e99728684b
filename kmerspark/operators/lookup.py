"""Looking k-mers up in a table of counts.

Defined results: a null seq counts as an empty one; rows that share a seq_id, or
have none, are reads of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerspark.functions import codec
from kmerspark.operators.windows import kmer_codes
from kmerspark.rows import numbered


def lookup(counts: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(code, ...) with cnt (0 if absent) and found."""
    return probes.join(counts.select("code", "cnt"), "code", "left").withColumn("found", F.col("cnt").isNotNull()).withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def read_counters(reads: DataFrame, counts: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(seq_id, n, total, nonzero, counters) of reads(seq_id, seq): the count at each window of a read, 0 where it has a special character or is absent.

    A read shorter than k has no counters.  Distinct k-mers of the reads meet the counts; a frequent one does so once.
    """
    kept, row = numbered(reads.select("seq_id", "seq"))
    windows = kmer_codes(kept.select(F.col(row).alias("seq_id"), "seq"), k)
    probe = windows.select("code").distinct()
    if canonical:
        probe = probe.withColumn("key", codec.encode(codec.canonical(codec.decode("code", k))))
    else:
        probe = probe.withColumn("key", F.col("code"))
    known = probe.join(counts.select(F.col("code").alias("key"), "cnt"), "key").select("code", "cnt")
    hits = windows.join(known, "code").groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "cnt"))).alias("hits"))
    n = F.greatest(F.length(F.coalesce("seq", F.lit(""))) - k + 1, F.lit(0))
    rows = kept.select(row, "seq_id", n.alias("n")).join(hits.withColumnRenamed("seq_id", row), row, "left")
    # the zeros before each hit, the hit, and the zeros after the last
    gap = lambda a, b: f"array_repeat(0L, {b} - {a} - 1)"
    full = F.expr(f"IF(hits IS NULL, array_repeat(0L, n), flatten(concat(transform(hits, (h, i) -> concat({gap('IF(i = 0, -1, hits[i - 1].pos)', 'h.pos')}, array(h.cnt))), array({gap('element_at(hits, -1).pos', 'n')}))))")
    out = rows.select("seq_id", F.col("n").cast("long").alias("n"), full.alias("counters"))
    return out.select("seq_id", "n", F.aggregate("counters", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("counters", lambda x: x > 0)).cast("long").alias("nonzero"), "counters")
