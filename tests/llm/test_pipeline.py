"""The pipeline's stages over small tables."""

import os

import corpus_pipeline
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").persist()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "best-fit packing"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DIR).persist()
        assert after.dtypes == docs.dtypes, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        gone = {r.doc_id for r in before.select("doc_id").collect()} - kept
        if name == names[0]:
            assert sum(labels.get(d) == 1 for d in gone) <= 0.02 * sum(q == 1 for q in labels.values())
            assert sum(labels.get(d) == 0 for d in kept) <= 0.1 * sum(q == 0 for q in labels.values())
        before = after
    texts = [r.text for r in before.collect()]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 100
