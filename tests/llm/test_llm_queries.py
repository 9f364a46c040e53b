"""Queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import pytest

import check_queries
import corpus_pipeline
from burstlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = check_queries.compare(spark, check_queries.database(FOLDER), FOLDER, name, QUERIES[name], SQL.get(name))
    assert got.startswith(("ok", "rows")), got


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= len(before)
            for r in docs.collect():
                assert name == "line_dedup" or r.text == before[r.doc_id]
                assert r.n_chars == len(r.text) or name == "quality_rules"
    packed = sorted(map(str, docs.drop("sequence_id", "offset").collect()))
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == packed
    assert set(r.doc_id for r in docs.select("doc_id").collect()) <= set(before)
