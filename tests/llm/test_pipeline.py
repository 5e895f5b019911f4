"""The corpus pipeline: each stage works on what its predecessor kept, and its decisions take effect."""

import corpus_pipeline
import pytest

from strideflow.llm import jaccard


def test_stages(spark, data):
    docs = corpus_pipeline.table(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "benchmark", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema if name != "encode" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and (name == "encode" or docs.columns == columns)
        ids = kept
        if name == "near_copies":
            assert jaccard.link_components(docs).where("component_id <> doc_id").count() == 0
    assert 0.5 * before < len(ids) < before


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, data, k):
    docs = corpus_pipeline.table(spark, data, "documents").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, data).collect() == []
