"""Sections meet pages by a sweep, against every pair; spans in stripped text, against joining."""

import random
import time

from pyspark.sql import functions as F

from sextant.operators import documents


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(6)
    spans, sections = [], []
    for doc in [*range(25), None]:
        at, n = 0, 0
        for _ in range(rng.randint(0, 12)):
            n, size = n + 1, rng.choice([0, 1, 5, 30])
            spans.append((doc, n, at, at + size))
            at += size + rng.choice([0, 2])
        for k in range(rng.randint(0, 12)):
            a = rng.randint(0, at + 3)
            sections.append((doc, k, a, a + rng.choice([0, 1, 2, 10, 60]), "text"))
    s = spark.createDataFrame(sections, "id int, k int, source_start int, source_end int, page_number string")
    got = documents.section_pages(s, spark.createDataFrame(spans, "id int, page_number int, start int, end int")).collect()
    want = []
    for doc, k, a, b, _ in sections:
        over = [n for d, n, x, y in spans if d == doc and x < y and x < b and y > a]
        want.append((doc, k, min(over, default=None), max(over, default=None)))
    assert sorted(((r["id"], r["k"], r["page_start"], r["page_end"]) for r in got), key=str) == sorted(want, key=str)


def test_a_document_of_many_pages_stays_linear(spark):
    pages = spark.range(100_000).select(F.lit("d").alias("id"), (F.col("id") + 1).alias("page_number"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    sections = spark.range(100_000).select(F.lit("d").alias("id"), F.col("id").alias("k"), (F.col("id") * 10 + 7).alias("source_start"), (F.col("id") * 10 + 12).alias("source_end"))
    began = time.time()
    found = documents.section_pages(sections, pages)
    assert found.where("page_start = k + 1 AND page_end = least(k + 2, 100000)").count() == 100_000
    assert time.time() - began < 60


def test_spans_move_with_the_stripped_text(spark):
    for texts in (["", " \n", "  first page ", "second", "\t", ""], ["x"], ["", ""], ["a ", " b\n"], ["", "mid  ", "", "end"]):
        df = spark.createDataFrame(list(enumerate(texts, 1)), "page_number int, text string").withColumn("id", F.lit("d"))
        got = {r["page_number"]: (r["start"], r["end"]) for r in documents.rebased_spans(documents.page_spans(df)).collect()}
        joined, at, want = "\n\n".join(texts), 0, {}
        lead, size = len(joined) - len(joined.lstrip()), len(joined.strip())
        for n, t in enumerate(texts, 1):
            want[n] = tuple(min(max(x - lead, 0), size) for x in (at, at + len(t)))
            at += len(t) + 2
        assert got == want
