"""Texts that take their time go to tasks of a fixed size, however few files they come from."""

import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import citations, documents


def one_file(spark):
    return spark.range(0, 1000, 1, 1).select("id", F.repeat(F.concat(F.lit("Some Act of "), "id", F.lit("\n")), 400).alias("raw_text"), F.lit("act_1.pdf").alias("source_file_name"))


def test_metadata_of_one_file_is_found_in_several_tasks(spark):
    found = documents.metadata(one_file(spark))
    assert found.rdd.getNumPartitions() > 2 and found.where("title LIKE 'Some Act%'").count() == 1000


def test_title_in_the_fortieth_line_and_not_beyond(spark):
    rows = [(k, "x" * 300 + "\n" + "a line\n" * (k - 2) + "The Levies Act, No. 5 of 1999\nmore", "act_7.pdf") for k in (40, 41)]
    got = {r.id: r.title for r in documents.metadata(spark.createDataFrame(rows, "id long, raw_text string, source_file_name string")).collect()}
    assert got == {40: "The Levies Act", 41: "act 7"}


def test_references_of_one_file_are_matched_in_several_tasks(spark, monkeypatch):
    seen = []
    whole = citations.match_offsets
    monkeypatch.setattr(citations, "match_offsets", lambda texts: seen.append(texts.rdd.getNumPartitions()) or whole(texts))
    citations.extract_references(one_file(spark), text="raw_text")
    assert seen[0] > 2


@pytest.mark.parametrize("mark", ["", citations.MARK, "ü"])
def test_offsets_are_those_of_the_patterns(spark, mark):
    text = f"{mark} The Levies Act, No. 5 of 1999. See SECTION 12 and ſection 3, item 4{mark}; paragraph (b) of subsection (2), s. 7, sec. 8, Second Schedule, Chapter 9A{mark}"
    got = sorted((r["pass"], r.start, r.stop, r.raw) for r in citations.match_offsets(spark.createDataFrame([(1, text), (2, "nothing here")], "doc long, text string")).where("doc = 1").collect())
    size = lambda at: len(text[:at].encode())
    want = sorted((k, size(m.start()), size(m.end()), m.group()) for k, name in enumerate(citations.NAMES) for m in re.finditer(citations.PATTERNS[name][0], text, re.I | re.S))
    assert got == want and len(got) >= 8
