"""What the pipeline leaves on disk, and pairs of sets that need not be read."""

import gc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import mixing, set_join, token_output
from sextant.llm.common import WIDE, settle, shared_dir
from sextant.llm.queries import tokenizer_path


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (blocks.apply(k).name() for k in range(blocks.size())) if b.startswith("shuffle_")}


def test_shuffles_go_when_their_result_is_settled(spark):
    before = shuffle_files(spark)
    settled = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert shuffle_files(spark) <= before
    assert settled.count() == 7


def test_stages_leave_only_the_last_result(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k} of some words", "en", "s", 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", "an item that occurs nowhere")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 20
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert left == {"sextant-mixture", "pipeline-tokens"}


def test_first_of_a_component_with_equal_and_null_ids(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same), (3, same.upper()), (3, same), (3, same), (None, same), (None, "another text of its own"), (9, "a third one")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect()) == [(False, 3, same.upper()), (False, 9, "a third one"), (True, None, "another text of its own")]


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng, bits = np.random.default_rng(3), lambda x, y: int(np.bitwise_count(x ^ y).sum())
    for n in (0, 1, 30, 300, 3000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[n // 5 :], rng.integers(0, 2**64, n // 10, dtype=np.uint64))))
        assert bits(set_join.sketch(x), set_join.sketch(y)) <= len(np.setxor1d(x, y))
    apart = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2)]
    assert bits(*map(set_join.sketch, apart)) > 600 / 9  # as many as sets of this size may differ in


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_near_duplicates_leave_only_the_rows_that_go(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(30)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(50, texts[3] + " more", "en", "s", 1), (2, texts[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir())
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    left = set(shared.iterdir()) - before
    assert {p.name.rsplit("-", 1)[0] for p in left} == {"sextant-gone", "sextant-repeated"}
    assert all("text" not in spark.read.parquet(str(p)).columns for p in left)
    assert sorted(r.doc_id for r in got.collect()) == list(range(30))


def test_equal_rows_leave_one_with_its_own_columns(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same, "en", "a", 1), (1, same, "de", "b", 2), (1, same, None, None, 3), (None, None, "x", "p", 4), (None, None, "y", "q", 5), (None, "", "z", "r", 6), (7, "a text apart", "en", "s", 7)]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert len(got) == 3 and set(got) <= set(rows)
    assert sorted(map(repr, (r[:2] for r in got))) == sorted(map(repr, [(1, same), (None, None), (7, "a text apart")]))


def test_mixture_moves_texts_once(spark):
    docs = spark.createDataFrame([(k % 7 or None, f"text {k} " * (k % 3), "en", "ab"[k % 2] if k % 5 else None, 1) for k in range(60)], DOCS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = corpus_pipeline.mixture(spark, docs, "")
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_own" in x]
        copies = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    assert copies == +want


def test_wide_rows_go_to_python_a_few_mb_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    texts = spark.range(6000).coalesce(1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    before = {key: spark.conf.get(key, None) for key in WIDE}
    found = settle(texts.mapInArrow(sizes, "rows long, bytes long"), "test", wide=True).collect()
    assert sum(r.rows for r in found) == 6000 and max(r.bytes for r in found) < 5 << 20
    assert {key: spark.conf.get(key, None) for key in WIDE} == before


def test_encoders_go_when_their_file_is_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some text {k}") for k in range(20)], "doc_id long, text string")
    token_output.write_tokens(docs, str(tmp_path / "tokens"), tokenizer_path(), end_id=1)
    assert token_output.read_tokens(spark, str(tmp_path / "tokens")).count() == 20

    def encoders(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, token_output.Encoder) for x in gc.get_objects())])], ["n"])

    assert sum(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(encoders, "n long").collect()) == 0
