"""The persistent index against the table, and how many of its files a search reads."""

import random
import re

import pytest

from kmerspark.functions import codec
from kmerspark.jobs import cli
from kmerspark.operators import index


def files_read(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles() if "/ranges/" in f}


@pytest.mark.parametrize("k", [9, 32])
def test_search(spark, tmp_path, k):
    rng = random.Random(k)
    top = 1 << 2 * k
    codes = [rng.randrange(top) for _ in range(2000)] + [77] * 900 + [0, top - 1]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    at = f"file://{tmp_path}/index"
    index.write_index(spark.createDataFrame([(c,) for c in signed], "code long"), at, rows=300)
    first = {}
    for i, c in enumerate(sorted(codes)):
        first.setdefault(c, i)
    probes = [*rng.sample(codes, 200), 77, 0, top - 1, 78, 5, None]
    df = spark.createDataFrame([(None if c is None else c - (1 << 64) if c >> 63 else c, "x") for c in probes], "code long, name string")
    got = index.search_index(spark, at, df)
    assert sorted((str(r.code), r.pos, r.name) for r in got.collect()) == sorted((str(None if c is None else c - (1 << 64) if c >> 63 else c), first.get(c), "x") for c in probes)
    every = files_read(got)
    one = index.search_index(spark, at, df.where("code = 77"))
    assert len(every) >= 8 and len(files_read(one)) == 1 and {r.pos for r in one.collect()} == {first[77]}
    assert not files_read(index.search_index(spark, at, df.where("code IS NULL")))


def test_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "code long")
    index.write_index(empty, f"file://{tmp_path}/none")
    assert [r.pos for r in index.search_index(spark, f"file://{tmp_path}/none", spark.createDataFrame([(3,)], "code long")).collect()] == [None]


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: f"file://{tmp_path}/{name}"
    spark.createDataFrame([(x,) for x in ("AACG", "ACGA", "TTTT", "GTAC")], "kmer string").select(codec.encode("kmer").alias("code")).write.parquet(at("set"))
    cli.main(["index", "-o", at("index"), at("set")], spark)
    cli.main(["search", "--indexed", "-m", "GTAC", at("index")], spark)
    out = capsys.readouterr().out
    assert re.search(r"GTAC\s*\|2\s*\|", out)
