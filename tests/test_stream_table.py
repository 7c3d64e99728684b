"""Counts added by streams, with batches that come again, against the counts of all."""

import random

import pytest

from kmerspark.operators.counting import count_kmers
from kmerspark.streaming import table


def seqs(spark, seed, n=20):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randrange(60)))) for i in range(n)], "seq_id long, seq string")


def rows(df):
    return sorted(map(tuple, df.select("code", "cnt").collect()))


def union(spark, *seeds):
    out = seqs(spark, seeds[0])
    for s in seeds[1:]:
        out = out.unionByName(seqs(spark, s))
    return out


@pytest.mark.parametrize("canonical", [False, True])
def test_batches_that_come_again(spark, tmp_path, canonical):
    at = f"file://{tmp_path}/t"
    add = lambda seed, query, batch: table.add_batch(seqs(spark, seed), 5, at, query, batch, canonical)
    want = lambda *seeds: rows(count_kmers(union(spark, *seeds), 5, canonical))
    assert rows(table.read_table(spark, at)) == []
    table.fold_table(spark, at)
    add(0, "q", 0), add(1, "q", 1), add(1, "q", 1)
    assert rows(table.read_table(spark, at)) == want(0, 1)
    table.fold_table(spark, at)
    assert not add(1, "q", 1) and add(2, "q", 2) and add(0, "p", 0)  # the last is of another query
    before = table.read_table(spark, at)
    assert rows(before) == want(0, 1, 2, 0)
    table.fold_table(spark, at)
    table.fold_table(spark, at)
    assert rows(before) == want(0, 1, 2, 0) == rows(table.read_table(spark, at))  # reads that have begun go on
    add(3, "q", 3)
    table.fold_table(spark, at)
    assert rows(table.read_table(spark, at)) == want(0, 1, 2, 0, 3)
    assert sorted(p.name for p in (tmp_path / "t" / "bases").iterdir()) == ["1", "2"] and sorted(p.name for p in (tmp_path / "t" / "batches" / "q").iterdir()) == ["3"]
    with pytest.raises(ValueError, match="counts k = 5"):
        table.add_batch(seqs(spark, 0), 6, at, "q", 9, canonical)


def test_unfinished_writes_do_not_count(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    table.add_batch(seqs(spark, 0), 5, at, "q", 0)
    table.add_batch(seqs(spark, 1), 5, at, "q", 1)
    table.add_batch(seqs(spark, 2), 5, at, "q", 2)
    (tmp_path / "t/batches/q/2/_SUCCESS").rename(tmp_path / "kept")
    (tmp_path / "t/batches/q/1/_SUCCESS").unlink()
    assert rows(table.read_table(spark, at)) == rows(count_kmers(seqs(spark, 0), 5))
    (tmp_path / "kept").rename(tmp_path / "t/batches/q/2/_SUCCESS")
    table.fold_table(spark, at)
    assert table.add_batch(seqs(spark, 1), 5, at, "q", 1)  # 2 has not been folded before it
    table.add_batch(spark.createDataFrame([], "seq_id long, seq string"), 5, at, "q", 2)
    table.fold_table(spark, at)
    (tmp_path / "t/bases/1/upto/_SUCCESS").unlink()
    table.add_batch(seqs(spark, 1), 5, at, "q", 1)
    assert rows(table.read_table(spark, at)) == rows(count_kmers(union(spark, 0, 1), 5))
    table.fold_table(spark, at)
    assert rows(table.read_table(spark, at)) == rows(count_kmers(union(spark, 0, 1), 5))


def test_stream_that_fails_and_goes_on(spark, tmp_path):
    """The batch in which it fails comes again with the same number, after its counts were written."""
    at, source = f"file://{tmp_path}/t", tmp_path / "in"
    for i in range(5):
        seqs(spark, i).coalesce(1).write.mode("append").parquet(f"file://{source}")
    add, fail = table.into_table(5, at, every=2), [True]

    def adds(df, batch):
        add(df, batch)
        if batch in (1, 2) and fail:  # 1 has been folded, 2 has not
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        query = stream.writeStream.foreachBatch(adds).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()

    for fails in (True, False):
        if not fails:
            fail.clear()
            run()
        else:
            with pytest.raises(Exception, match="lost"):
                run()
    assert rows(table.read_table(spark, at)) == rows(count_kmers(union(spark, 0, 1, 2, 3, 4), 5))
    with pytest.raises(RuntimeError, match="add_batch"):
        add(seqs(spark, 0), 0)
