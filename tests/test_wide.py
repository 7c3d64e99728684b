"""The transform by prefix doubling against a plain version and against the one by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from kmerspark.operators import compress, wide


@pytest.mark.parametrize("width", [1, 2, 11])
def test_wide(spark, width):
    rng = random.Random(width)
    rows = [(i * 7 - 50, "".join(rng.choices("ACé", [5, 2, 1], k=width))) for i in range(60)] + [(1000 + i, "A" * width) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row long, s string")
    want = []
    for j in range(width):
        order = sorted(rows, key=lambda r: (r[1][:j][::-1], r[0]))
        want += [(j, i, row, s[j]) for i, (row, s) in enumerate(order)]
    got = wide.pbwt_wide(df, width)
    assert sorted(tuple(r) for r in got.select("col", "rank", "row", "value").collect()) == sorted(want)
    whole = compress.pbwt_encode(df.withColumn("block", F.lit(0).cast("long")), width)
    assert sorted((r.col, r["rank"], r.row, r.value) for r in whole.collect()) == sorted(want)
    assert wide.pbwt_wide(df.where("false"), width).count() == 0
    with pytest.raises(Exception, match="characters"):
        wide.pbwt_wide(df, width + 1).collect()


def test_wide_by_rounds_is_the_same(spark):
    """Ranks that reach 1, 2, 3 or all characters before the rounds begin."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACé", [5, 2, 1], k=11))) for i in range(50)]
    df = spark.createDataFrame(rows, "row long, s string")
    one, *others = (sorted(map(tuple, wide.pbwt_wide(df, 11, first=n).collect())) for n in (64, 1, 2, 3, 10, 11))
    assert len(one) == 550 and all(o == one for o in others)


@pytest.mark.parametrize("first", [2, 64])
def test_wide_broadcasts_no_cells(spark, tmp_path, first):
    """Cells compress to next to nothing on disk, so Spark takes their table for a small one."""
    df = spark.range(3000).select(F.col("id").alias("row"), F.repeat(F.lit("ACGT"), 3).alias("s"))
    plans = []
    plain = type(df).join

    def join(self, other, *a, **kw):
        out = plain(self, other, *a, **kw)
        if {"row", "col"} <= set(self.columns) and a != ("_range",):
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    type(df).join = join
    try:
        got = wide.pbwt_wide(df, 12, first=first)
    finally:
        type(df).join = plain
    assert got.count() == 36000 and (plans or first == 64)
    assert not any("BroadcastHashJoin" in line and "_range" not in line for p in plans for line in p.splitlines())
