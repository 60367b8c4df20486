"""Pipeline stages on documents whose extra columns bear the names that stages use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
NAMES = "key fp component front n _size _rank _doc _hash _source _copies _turn _own _n _copy rate size taken bucket node a b c token".split()


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:-1]], ids=[n for n, _ in pipeline.STAGES[:-1]])
def test_clashing_columns_pass_through(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({name: F.concat(F.lit(f"{name} "), "doc_id") for name in NAMES})
    out = stage(spark, more, SF)
    assert out.columns == more.columns
    rows = out.collect()
    assert all(r[name] == f"{name} {r['doc_id']}" for r in rows for name in NAMES)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, docs, SF).select("doc_id").collect())


def test_last_stage_reads_past_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({name: F.lit("x") for name in (*NAMES, "start", "segment", "payload")})
    assert pipeline.tokens(spark, docs, SF).count() == docs.count()
