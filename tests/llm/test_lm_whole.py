"""The language model learns from all training text, not from a sample."""

import pytest
from pyspark.sql import functions as F

from sextant.llm import lm_score, queries


def test_all_training_text_is_learned_from(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words "), "id", F.lit(" ")), 25_000).alias("text"))
    seen = []

    def stop(sequences, *rest):
        seen.append(sequences.count())
        raise RuntimeError("seen")

    monkeypatch.setattr(lm_score, "train", stop)
    with pytest.raises(RuntimeError, match="seen"):
        lm_score.score_documents(docs, F.col("doc_id") >= 36, queries.tokenizer_path("piece_bpe_32k.model"))
    assert seen == [36]
