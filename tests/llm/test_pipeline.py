import corpus_pipeline
from webloom.llm import near
from webloom.llm.shared import stored

from .data import empty, frame
from .test_credentials import brute as spans


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, sf), "test")
        assert after.columns == docs.columns and after.count() <= before.count()
        if name == "near duplicates":
            found = near.classes(before)
            assert after.count() == found.select("class_id").distinct().count()
        if name == "secrets":
            assert after.count() == before.count() and not any(spans(r.text) for r in after.collect())
            changed = {r.doc_id for r in before.join(after, ["doc_id", "text"], "left_anti").collect()}
            assert changed == {r.doc_id for r in before.collect() if spans(r.text)}
        before = after
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_odd_documents(spark, sf):
    for docs in (frame(spark), empty(spark)):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, sf), "test")
        assert (out.count() > 0) == (docs.count() > 0)
