"""Packed runs: exact round trips, the bits that the code promises, and blocks decoded apart."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from kmerspark.operators import bits, compress


def rows_of(spark, texts):
    return spark.createDataFrame([(i, s, "x") for i, s in enumerate(texts)], "row long, s string, data string")


def test_round_trip(spark):
    rng = random.Random(3)
    texts = ["".join(c * int(rng.expovariate(0.02) + 1) for c in rng.choices("ACGTNé日", [9, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 60))) for _ in range(40)] + ["", None, "A", "A" * 70_000, "AC" * 3000]
    rows = rows_of(spark, texts)
    runs = compress.rle_runs(rows)
    book = bits.run_code(runs)
    packed = bits.encode_runs(rows, book, 100).cache()
    key = lambda df: sorted(tuple(r) for r in df.select("row", "start", "value", "length").collect())
    assert key(bits.decode_runs(packed, book)) == key(runs)
    assert packed.where("part > 0").count() > 20 and packed.where("runs > 100").count() == 0
    assert packed.agg({"bits": "sum"}).first()[0] == compress.huffman_bits(runs).first().bits
    assert all(len(r.data) == -(-r.bits // 8) for r in packed.collect())
    some = packed.where("row = 44 AND part = 7")
    assert key(bits.decode_runs(some, book)) == [r for r in key(runs) if r[0] == 44 and 700 <= r[1] < 800]
    empty = rows.where("false")
    assert bits.run_code(compress.rle_runs(empty)) == {} and bits.encode_runs(empty, {}).count() == 0


def test_what_cannot_be_written_raises(spark):
    rows = rows_of(spark, ["AAC"])
    book = bits.run_code(compress.rle_runs(rows))
    with pytest.raises(Exception, match="no word"):
        bits.encode_runs(rows_of(spark, ["AAG"]), book).collect()
    with pytest.raises(Exception, match="stands for a digit"):
        bits.encode_runs(rows_of(spark, ["AĀ"]), book).collect()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 400), st.integers(1, 10**6), min_size=1, max_size=40))
def test_codewords_are_in_order_once_filled_up(counts):
    book = compress.codebook(counts)
    words = [book[s] for s in sorted(book, key=lambda s: (len(book[s]), s))]
    width = max(map(len, words))
    assert [w.ljust(width, "0") for w in words] == sorted(w.ljust(width, "0") for w in words)
    assert len(book) == 1 or sum(2.0 ** -len(w) for w in words) == 1
