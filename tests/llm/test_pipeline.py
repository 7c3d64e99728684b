"""The pipeline's stages, each held against its input."""

import random
from collections import defaultdict

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    first, near, clean, mixed = kept.values()
    groups = brute.groups([i for i, _ in first], [brute.simhash(t) for _, t in first])
    assert sorted(i for i, _ in near) == sorted(set(groups.values()))
    bad = {i for i, t in near if brute.contamination(t, items)[-1]} if len(near) < 1200 else set()
    assert {i for i, _ in clean} == {i for i, _ in near} - bad and bad
    times = defaultdict(int)
    for i, _ in mixed:
        times[i] += 1
    assert set(times) <= {i for i, _ in clean} and max(times.values()) == 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == len(mixed)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())


def odd_corpus(rng):
    text = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(n))
    passage, copy, long = text(40), text(90), text(30_000)
    rows = [(i, text(rng.randint(55, 200)), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(7, text(80), "a"), (None, text(80), "b"), (None, text(80), None), (100, copy, "a"), (101, copy, "b"), (100, copy, "a"), (None, copy, "a")]
    rows += [(102, None, "a"), (103, "", None), (104, "short", "a"), (105, f"{text(60)} {passage} {text(60)}", "b"), (None, f"{passage} {text(80)}", "b"), (106, long, "a")]
    return [(*r, "x", "y", 3) for r in rows], passage


def test_stages_on_odd_rows(spark, tmp_path):
    rows, passage = odd_corpus(random.Random(3))
    schema = "doc_id long, text string, source string, _row string, spans string, copies int"
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept[name] = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)
    good, near, clean, mixed = kept.values()
    assert good == sorted(((i, t, s) for i, t, s, *_ in rows if len((t or "").split()) >= 50), key=str)
    assert len([t for _, t, _ in near if t == good[0][1]]) <= 1 and len({t for _, t, _ in near}) == len(near) and (100, next(t for i, t, *_ in rows if i == 101), "a") in near
    assert len([1 for i, *_ in near if i is None]) == 3 and len([1 for i, *_ in near if i == 7]) == 2
    assert clean == [r for r in near if passage not in r[1]] and len(clean) == len(near) - 2
    assert set(mixed) <= set(clean)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(r["size"] for r in out.collect()) == sorted(len(t.encode()) + 1 for _, t, _ in mixed)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
