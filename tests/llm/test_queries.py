"""The registered queries keep their contract at the smallest scale."""

import corpus_pipeline
from captionforge.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_pipeline_keeps_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, frame = {r.doc_id for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialize(stage(spark, frame, sf_dir), "stage")
        assert frame.schema == docs.schema, name
        left = [r.doc_id for r in frame.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids, name
        ids = set(left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert {r.doc_id for r in pieces} == ids
    assert all(len(r.ids) == 4 * r.length and r.length <= 2048 for r in pieces)


def test_pipeline_on_an_empty_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir) if _ == "packing" else corpus_pipeline.materialize(stage(spark, frame, sf_dir), "stage")
    assert frame.count() == 0
