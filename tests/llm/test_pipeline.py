"""The pipeline's stages against plain versions on a small input."""

import corpus_pipeline
from tests.llm import brute
from tidelight.llm import near_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "t")
        assert docs.columns == columns
        kept[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
    before, after = kept["exact dedup"]
    assert set(after) == {max(i for i, t in before.items() if t == x) for x in before.values()}
    before, after = kept["MinHash near-dedup"]
    assert set(after) == {i for i, _, _, k in brute.near(list(before.items()), 80, 5) if k}
    before, after = kept["substring dedup"]
    want = {i: n - r for i, n, r, _ in brute.repeats(list(before.items()), 50)}
    assert {i: len(t.encode().split()) for i, t in after.items()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(100))
    d = spark.createDataFrame([(3, text, "a"), (1, text + " x", "b"), (2, "other words here and there", "c")], "doc_id long, text string, bands string")
    assert {r["doc_id"] for r in near_dedup.drop_near(d).collect()} == {1, 2}
