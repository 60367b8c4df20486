"""Sections and references in statute text: labelled cases, and what must hold for any text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import citations, segments

S = "SECTION"
CASES = {
    "parts": ("PART I\nPreliminary\n\n1. Short title.\nText.\n\nPART II\nGENERAL PROVISIONS\nAND MORE\n\n2. Powers.\nMore.\n", [("PART I", "PART I", "PART"), ("1", "Short title", S), ("PART II", "PART II\nGENERAL PROVISIONS\nAND MORE", "PART"), ("2", "Powers", S)]),
    "part in a sentence": ("PART III\nGENERAL\n\n1. Application.\nPart IV of this Act, dealing with more, applies.\n2. X\n", [("PART III", "PART III\nGENERAL", "PART"), ("1", "Application", S), ("2", "X", S)]),
    "margins": ("Short title\n1. This Act may be cited.\n\nAmendment of section 3\n  2. Section 3 is hereby amended.\nNotes.\nShort title.\n3. Y", [("1", "Short title", S), ("2", "Amendment of section 3", S), ("3", "Y", S)]),
    "numbers alone": ("1.\n\nShort title\n2.\n3.\n4. Foo; bar\n", [("1", "Short title", S), ("2", "3", S), ("4", "Foo", S)]),
    "schedules end sections": ("1. A.\nSchedule I or under item (a) here.\nFIRST SCHEDULE\nForms\n2. no\nPART I\n\nsecond schedule  \n", [("1", "A", S), ("FIRST SCHEDULE", "FIRST SCHEDULE", "SCHEDULE"), ("second schedule", "second schedule", "SCHEDULE")]),
    "cover": ("PARLIAMENT OF THE DEMOCRATIC SOCIALIST REPUBLIC\nDRUGS (AMENDMENT) ACT\nNo. 7 of 2026\nPrice : Rs. 12.00\n\n1. Short title.\nBody.", [("1", "Short title", S)]),
    "preamble": ("GAZETTE\n\n\nWhereas it is so\n\n\n\nand so\n1. X", [("PREAMBLE", "Preamble", "PREAMBLE"), ("1", "X", S)]),
    "no section": ("nothing here\n\n\nGazette\nmore\nFIRST SCHEDULE\n", [("0", "Document text", "OTHER")]),
    "long heading": ("1. " + "word " * 40 + "\n2. the end", [("1", None, S), ("2", "the end", S)]),
    "empty": ("", [("0", "Document text", "OTHER")]),
    "blank": (" \n\t ", [("0", "Document text", "OTHER")]),
    "null": (None, [("0", "Document text", "OTHER")]),
}


def test_labelled_sections(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "id string, raw_text string").withColumns({"k": F.lit(1), "doc": F.lit("x"), "line": F.lit("y")})
    got = {}
    for r in segments.segment(df).orderBy("id", "sort_order").collect():
        got.setdefault(r["id"], []).append(r)
    assert {k: [(r["section_number"], r["heading"], r["section_type"]) for r in rows] for k, rows in got.items()} == {k: want for k, (_, want) in CASES.items()}
    assert got["no section"][0]["text"] == "nothing here\n\nmore" and got["preamble"][0]["text"] == "Whereas it is so\n\nand so"
    assert got["margins"][1]["text"].startswith("Amendment of section 3\n  2. Section 3") and got["margins"][1]["text"].endswith("Short title.")


def test_blocks_tile_any_text(spark):
    rng = random.Random(2)
    lines = ["1. A", "2.", "3B. Section 4", "PART I", "Part II CAPS", "CAPS HERE", "SCHEDULE", "Short title", "", "  ", "plain words", "Amendment", "gazette", "é. 漢", "  7. indented", "X\r"]
    texts = {k: "\n".join(rng.choices(lines, k=rng.randint(0, 25))) for k in range(120)}
    rows = segments.segment(spark.createDataFrame(list(texts.items()), "id int, raw_text string")).orderBy("id", "sort_order").collect()
    for k, t in texts.items():
        own = [r for r in rows if r["id"] == k]
        assert [r["sort_order"] for r in own] == list(range(len(own)))
        assert [r["source_end"] for r in own[:-1]] == [r["source_start"] for r in own[1:]] and own[-1]["source_end"] == (len(t.rstrip()) if t.strip() else len(t))
        for r in own:
            if r["section_type"] not in ("OTHER", "PREAMBLE"):
                assert r["text"] == t[r["source_start"] : r["source_end"]].strip()
        if own[0]["section_type"] != "OTHER":
            schedule = re.search(r"(?m)^SCHEDULE$", t)
            assert all(r["section_type"] == "SCHEDULE" for r in own if schedule and r["source_start"] >= schedule.start())


REFERENCES = {
    "amended": ("Section 9 of the Judicature Act, No. 2 of 1978 is hereby amended. See section 12 here.", [("AMENDS", "Judicature Act", "2", 1978, "9", "9", 0.95), ("AMENDS", "Judicature Act", "2", 1978, None, None, 0.95)]),
    "principal": ("Section 3 of the principal enactment is hereby amended in item 4 thereof.", [("AMENDS", "principal enactment", None, None, "3", "3", 0.85), ("AMENDS", None, None, None, "4", "item 4", 0.7)]),
    "amending act": ("An Act to amend the Poisons Ordinance (Chapter 218)", [("AMENDS", "Poisons Ordinance", None, None, None, "Chapter 218", 0.85)]),
    "insert": ("the following new section is hereby inserted immediately after section 7 and shall have effect as section 7A of it", [("INSERTS", None, None, None, "7A", "after section 7; section 7A", 0.7), ("INSERTS", None, None, None, "7A", "7A", 0.7)]),
    "repeal": ("by the repeal of paragraph (B) of subsection (2) thereof", [("REPEALS", None, None, None, "(b)", "subsection (2) paragraph (B)", 0.7)]),
    "add": ("by the addition immediately after ITEM 3 of words", [("ADDS", None, None, None, "3", "item 3", 0.7)]),
    "weak alone": ("Section 5 says; subsection (3) too. Item 4 and paragraph (a).", []),
    "weak that relates": ("referred to in section 8; not in section 9", [("CROSS_REFERENCE", None, None, None, "8", "8", 0.7)]),
    "ungated": ("é漢😀 see the Second Schedule and Chapter 21A", [("UNKNOWN", None, None, None, None, "Second Schedule", 0.3), ("UNKNOWN", "Chapter 21A", None, None, None, None, 0.3)]),
    "one wording once": ("under section 5. under SECTION  5; under section 6", [("CROSS_REFERENCE", None, None, None, "5", "5", 0.7), ("CROSS_REFERENCE", None, None, None, "6", "6", 0.7)]),
    "none": ("plain", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_labelled_references(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in REFERENCES.items()], "id string, text string").withColumns({"pass": F.lit(1), "key": F.lit("x"), "raw": F.lit("y"), "doc": F.lit(0)})
    got = {k: [] for k in REFERENCES}
    for r in citations.extract_references(df).orderBy("id", "position").collect():
        got[r["id"]].append((r["relationship_type"], r["target_act_title_raw"], r["target_act_number"], r["target_act_year"], r["target_section_number"], r["target_section_path"], r["confidence_score"]))
    assert got == {k: want for k, (_, want) in REFERENCES.items()}


@pytest.mark.parametrize("size", [1, 400])
def test_offsets_and_bounds_against_python(spark, size):
    rng = random.Random(size)
    bits = ["under section 5. ", "é漢 Chapter 3;", "\n", "item 7 ", "😀", " Second Schedule ", "Levy Act, No. 3 of 1999 ", "x" * 50, ". ", "\uffff"]
    texts = {k: "".join(rng.choices(bits, k=rng.randint(0, 12) * size)) for k in range(40 if size == 1 else 2)}
    df = spark.createDataFrame(list(texts.items()), "doc int, text string")
    matches = citations.match_offsets(df)
    rows = citations._bounded(df, matches).collect()
    want = set()
    for k, t in texts.items():
        for n, name in enumerate(citations.NAMES):
            for m in re.finditer(citations.PATTERNS[name][0], t, re.I | re.S):
                a, b = m.span()
                left = max(t.rfind(c, 0, a) for c in ".;\n") + 1
                right = min((x for x in (t.find(c, b) for c in ".;\n") if x >= 0), default=None)
                size_of = lambda x: len(t[:x].encode())  # noqa: E731, B023
                want.add((k, n, m[0], size_of(a), size_of(b), size_of(left), None if right is None else size_of(right) + 1))
    got = {tuple(r[c] for c in ("doc", "pass", "raw", "start", "stop", "left", "right")) for r in rows}
    assert (sorted(got - want, key=str)[:5], sorted(want - got, key=str)[:5]) == ([], [])


def test_no_python_but_composition_in_the_plan(spark):
    df = spark.createDataFrame([("a", "x")], "id string, text string")
    for plan in (citations.extract_references(df), segments.segment(df, text="text")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in text and "nfkc" in text and text.count("ArrowEvalPython") <= 2
