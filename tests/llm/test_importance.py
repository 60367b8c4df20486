"""Importance resampling against brute force: ties, nulls, repeated rows, other parameters."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sextant.llm import importance


def features(text, order, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, share=(10, 100), least=20, buckets=10_000, order=1, seed="2024"):
    s, t = (Counter(f for _, text in rows for f in features(text, order, buckets)[1]) for rows in (docs, target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    rows = []
    for d, text in docs:
        n, found = features(text, order, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    k = share[0] * len(able) // share[1]
    return [(*(r[:1] + r[2:]), i + 1) for i, r in enumerate(able[:k])] + [(*(r[:1] + r[2:]), None) for r in able[k:] + [r for r in rows if r[1] < least]]


def table(n=300):
    rng = random.Random(9)
    vocabulary = ["the", "The", "a", "é", "İ", "42", "x_y", "漢字", "ﬀ", *(f"w{k}" for k in range(60))]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 40, 300])))) for k in range(n)]
    return [*docs, (5, docs[7][1]), (5, docs[7][1]), (None, docs[9][1]), (900, None), (901, ""), (902, "the " * 30_000)], [(0, "w1 w2 w3 the w4"), (1, None), (2, "w5 " * 50)]


@pytest.mark.parametrize("more", [{}, {"order": 3, "buckets": 50, "seed": "x"}, {"share": (99, 100), "least_words": 0}, {"share": (1, 1)}, {"share": (0, 1)}])
def test_matches_brute_force(spark, more, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 1 << 12)
    docs, target = table()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "rank": F.lit(0), "n": F.lit(0), "bucket": F.lit(1)})
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), **more).collect()
    args = {"least" if k == "least_words" else k: v for k, v in more.items()}
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, target, **args), key=str)


def test_equal_scores_go_by_doc_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    rows = [(k, "same " * 25 if k % 3 else "rare " * 20) for k in range(100)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("rare",)], "text string"), (40, 100)).collect()
    drawn = [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41))
    assert drawn == [k for k in range(100) if not k % 3] + [1, 2, 4, 5, 7, 8]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.resample(none, one).collect() == []
    assert [tuple(r)[1] for r in importance.resample(one, none, (1, 1)).collect()] == [30]
