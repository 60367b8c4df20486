"""Steps of the language model look at a bounded number of ids and bytes at a time, however many rows a task is handed."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sextant.llm import lm_score, queries


def test_followers_in_bounded_memory_are_those_of_all_ids():
    rng, end, size = np.random.default_rng(2), 999, 1000
    rank = np.full(size, -1)
    rank[:: size // 100] = np.arange(100)
    rank[end] = 100
    long = [np.append(rng.integers(0, end, n), end).astype("<u2") for n in (0, 5, 6_000_000, 3)]
    column = pa.array([x.tobytes() for x in long], pa.binary())
    tracemalloc.start()
    got = lm_score.followers_of([column], rank, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000, peak  # all ids at once: over 300 MB
    want = Counter()
    for x in long:
        before, after = rank[np.concatenate(([end], x[:-1]))], x.astype(np.int64)
        codes, n = np.unique((after << 16 | before)[before >= 0], return_counts=True)
        want.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert dict(map(tuple, got.tolist())) == want
    assert len(lm_score.followers_of([], rank, end)) == 0


def test_slices_hold_all_rows_in_order():
    for sizes in ([], [0], [3, 0, None, 50, 1, 1, 9, 10, 11, 0]):
        texts = pa.array([None if n is None else "x" * n for n in sizes], pa.string())
        found = list(lm_score.slices(texts, 10))
        assert [k for x in found for k in range(x.start, x.stop)] == list(range(len(sizes)))
        assert all(sum(n or 0 for n in sizes[x][1:]) < 10 for x in found)


def test_words_of_slices_are_those_of_their_rows():
    rows = ["Abc é d", "", " x Y ", "ÉÉé öö ü", "zz q", None, "Q"]
    for texts in (pa.array(rows), pa.array(rows[:5]), pa.array(rows[:5], pa.large_string()), pa.chunked_array([rows[:5], rows[5:]], pa.string())):
        own = texts.to_pylist()
        for a in range(len(own)):
            for b in range(a, len(own) + 1):
                words, at, n = lm_score.words_of(texts.slice(a, b - a))
                want = [pc.ascii_lower(pa.scalar(x or "")).as_py().split() for x in own[a:b]]
                assert words.take(pa.array(at)).to_pylist() == sum(want, [])
                assert n.tolist() == list(map(len, want))


def test_long_texts_are_learned_from_as_they_are(spark, monkeypatch):
    """Texts beyond ``SLICE_BYTES`` together, so that a batch is looked at in slices."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(k, f"Text {k} é " * (40_000 + k)) for k in range(30)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen = {}

    def stop(sequences, *rest):
        seen.update((r.id, np.frombuffer(r.ids, "<u2").tolist()) for r in sequences.collect())
        raise RuntimeError("seen")

    monkeypatch.setattr(lm_score, "train", stop)
    for null in (True, False):
        seen.clear()
        with pytest.raises(RuntimeError, match="seen"):
            lm_score.score_documents(docs if null else docs.where("text IS NOT NULL"), F.lit(False), path)
        cut = lm_score.Pieces(path)
        assert seen == {k: cut.texts(pa.array([t], pa.string()))[0].tolist() for k, t in rows if null or t is not None}
