"""Fill-in-the-middle against brute force: forms, cuts, exact restoration, hostile texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import fill_middle

ROW = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def brute(doc_id, text, rate=100, spm=50, seed="7", marks=("<P>", "<S>", "<M>")):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in marks) or h[2] % 100 >= rate:
        return (doc_id, len(u), "plain", None, None, t)
    x, y, z = marks
    if h[3] % 100 < spm:
        return (doc_id, len(u), "spm", len(p), len(m), f"{y}{s}{x}{p}{z}{m}")
    return (doc_id, len(u), "psm", len(p), len(m), f"{x}{p}{y}{s}{z}{m}")


def texts(n=400):
    rng, bits = random.Random(5), ["a", "é", "漢", "😀", "\n", "\n", "\r", "<", "<P", "P>", "<S", "S>", "<M>", "<P>", "<S>", ">", " ", "\x00", " "]
    out = ["".join(rng.choices(bits[: 12 if k % 3 else 19], k=rng.choice([0, 1, 2, 5, 30, 600]))) for k in range(n)]
    return [*out, None, "", "\n", "\n\n", "x", "x\n", "<P", "<", "é" * 5000 + "\n" + "漢" * 3000, "<P" * 700, "a\n" * 5000]


@pytest.mark.parametrize("rate", [100, 40])
def test_matches_brute_force(spark, rate):
    rows = list(enumerate(texts())) + [(3, "same\nid"), (3, "same\nid"), (None, "no\nid\nat all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit("clash"), "n": F.lit(1), "digest": F.lit("x"), "h0": F.lit(0)})
    found = fill_middle.fill_middle(df, rate=rate).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(d, t, rate) for d, t in rows), key=str)
    assert sorted((tuple(r[c] for c in ROW) for r in found), key=str) == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_other_sentinels_and_keys(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(f"k{i}", t.replace("<P>", marks[0]) if t else t) for i, t in enumerate(texts(80))]
    found = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id string, text string"), marks, "s", 90, 30).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks))
    got = found.collect()
    assert sorted(tuple(r[c] for c in ROW) for r in got) == sorted((brute(d, t, 90, 30, "s", marks) for d, t in rows), key=lambda x: x[0])
    assert all(r["back"] == (dict(rows)[r["doc_id"]] or "") for r in got)


def test_lanes_of_any_length_agree(monkeypatch):
    many = [t.encode() for t in texts(60) if t is not None]
    seeds = np.random.default_rng(1).integers(0, 1 << 32, (len(many), 4))
    found = []
    for lane in (1, 7, 64, 1 << 14):
        monkeypatch.setattr(fill_middle, "LANE", lane)
        found.append(fill_middle.cut_texts(fill_middle.Automaton(fill_middle.SENTINELS), fill_middle.SENTINELS, many, seeds, 100, 50))
    assert all(f == found[0] for f in found)


def test_empty_table_and_bad_sentinels(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for bad in (("aa", "ab", "b"), ("<P>", "<P>x", "y"), ("é", "b", "c"), ("aba", "x", "y"), ("", "x", "y")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.check_sentinels(bad)
