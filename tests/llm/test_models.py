"""The two classifiers: held-out accuracy, and what must not leak or break."""

import numpy as np
from pyspark.sql import functions as F

from kmerspark.llm import language_id, sampling, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, "123 !?"), (None, "the and of"), (90004, "é " * 60_000), (90004, "é"), (90005, "\U0001f600")]


def odd(spark, docs):
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"), allowMissingColumns=True)


def test_folds(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", sampling.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language(spark):
    docs = odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    model = language_id.fit(docs, 100)
    out = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in out if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).where("doc_id > 90000 or doc_id is null").collect()}
    assert {(90001, "und"), (90002, "und"), (90003, "und"), (90005, "und")} <= got and len(got) >= 6
    assert (model["weights"] == 0).mean() > 0.2  # sparse
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id < 5").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_does_not_look_at_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(sampling.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, language_id.identify(d, 50).collect()))
    assert key(docs) == key(other)


def test_temperature_sharpens_and_softens():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 500)
    logits = np.eye(3)[y] * 2
    wrong = rng.random(500) < 0.3
    logits[wrong] = np.eye(3)[(y[wrong] + 1) % 3] * 2
    assert language_id.temperature(logits, y) > 1 > language_id.temperature(np.eye(3)[y] * 2, y)


def test_toxicity(spark):
    big = "/root/testdata/sf0.1"  # enough toxic documents to learn from
    docs, labels = odd(spark, spark.read.parquet(f"{big}/documents.parquet")), spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    bad, good = ([r.score for r in out if r.held_out and truth.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean([x > y for x in bad for y in good]) > 0.95 and np.mean([y >= 0.7 for y in good]) < 0.01
    assert np.mean([x >= 0.7 for x in bad]) > 0.75
    assert {r.doc_id: r.score for r in out if r.doc_id in (90001, 90002)} == {90001: 0.0, 90002: 0.0}
    assert {r.score for r in toxicity.toxicity(docs.limit(5), labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_misspellings_share_subwords():
    rng = np.random.default_rng(2)
    filler = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]
    line = lambda *extra: " ".join([*rng.choice(filler, 15), *extra])
    toxic = [toxicity._segments(line("wretchedness")) for _ in range(60)]
    clean = [toxicity._segments(line(str(rng.choice(filler)))) for _ in range(200)]
    add, bias = toxicity.train(toxic, clean)
    assert toxicity.log_odds(line("wretchednes"), add, bias) > 0 > toxicity.log_odds(line("kilo"), add, bias)


def test_samples_are_bounded_where_rows_repeat(spark):
    rows = [(1, "same id and language", "en")] * 300 + [(2, f"text {i}", "en") for i in range(50)] + [(i, "autre", "fr") for i in range(3, 9)] + [(None, "none", "fr")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _hash string")
    picked = sampling.sample_per_label(docs, "lang", 4)
    texts = sampling.texts_of(docs, picked, ["doc_id", "lang"]).collect()
    assert len(texts) == picked.count() <= 6 and len({(r.doc_id, r.lang) for r in texts}) == len(texts)
    assert language_id.identify(docs).count() == len(rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)


def test_wrong_labels_do_not_flatten_the_curve():
    rng = np.random.default_rng(3)
    y = np.array([1] * 60 + [0] * 300)
    x = np.where(y == 1, 12.0, 0.0) + rng.normal(0, 2, 360)
    slope, offset = toxicity.calibrate(x, y)
    x[:3] = -9.0  # toxic by label only
    s, o = toxicity.calibrate(x, y)
    assert s > 0.6 * slope and s * 10 + o > 0 > s * 4 + o
    assert toxicity.calibrate(x, np.zeros(360, int)) == (1.0, 0.0)


def test_words_are_hashed_whole():
    whole = lambda t: set(toxicity.subwords(t)[0].tolist())
    assert whole("ab") != whole("ba") and whole("a b") == whole(" b  a ") and len(whole("a")) == 2  # the word, and the word with its ends
    assert whole("abcdefghi") - whole("abcdefghj") and whole("abcdefghi") & whole("abcdefghj")
