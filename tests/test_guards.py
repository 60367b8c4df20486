"""Guards, previews and choices on nulls, ties and empty tables; composed texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators import documents, mapping, segments, state


def test_search_form_composes_like_python(spark):
    rng = random.Random(1)
    letters = ["a", "Z", "9", "é", "É", "ß", "ÿ", "ž", "²", "½", "ª", "ﬁ", "Ａ", "é", "ö", " ", "ĳ", "ſ", "ŉ", "漢", "😀", "-", "\n", "①", "℡"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 8))) for _ in range(400)] + [chr(c) + "x" for c in range(1, 0x250)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.search_form(F.col("t")).alias("f"), F.col("t").rlike(X.COMPOSED).alias("plain")).collect():
        whole = unicodedata.normalize("NFKC", r["t"])
        low = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in whole.lower())
        assert r["f"] == " ".join(low.split()), repr(r["t"])
        assert not r["plain"] or whole == r["t"]


def test_delete_guards(spark):
    acts = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    refs = spark.createDataFrame([("a", "a", None), ("b", "a", "s1"), ("b", None, "s1"), ("b", "b", "s2"), (None, "c", None), ("a", None, "gone")], "source_act_id string, target_act_id string, target_section_id string")
    sections = spark.createDataFrame([("s1", "a"), ("s2", "c")], "id string, act_id string")
    jobs = spark.createDataFrame([("b", "QUEUED"), ("b", "RUNNING"), ("a", "FAILED"), (None, "RUNNING")], "act_id string, status string")
    assert {tuple(r) for r in state.delete_guards(acts, refs, sections, jobs).collect()} == {("a", 0, 2, False), ("b", 2, 0, False), ("c", 0, 2, False)}
    assert state.delete_guards(acts.limit(0), refs, sections, jobs).collect() == []
    assert all(r["deletable"] for r in state.delete_guards(acts, refs.limit(0), sections, jobs.limit(0)).collect())


def test_context_preview_and_summary(spark):
    rows = [("d", 1, None, False, "x"), ("d", 2, "a", True, "principal enactment"), ("d", 3, "b", None, "B Act"), ("d", 4, "c", False, "C Act"), ("e", 1, None, None, "y")]
    df = spark.createDataFrame(rows, "source_act_id string, position int, own string, principal boolean, raw_reference_text string")
    assert [tuple(r) for r in mapping.context_preview(df).collect()] == [("d", "b", "B Act")]
    texts = spark.createDataFrame([("p", "Words\n1. A\nPART I\n2. B\nSCHEDULE"), ("q", None)], "id string, raw_text string")
    assert {tuple(r) for r in segments.summary(segments.segment(texts)).collect()} == {("p", 2, 1, 1, False, True), ("q", 0, 0, 0, True, False)}


def test_native_first(spark):
    long = "a page that is long enough to count"
    rows = [("d", 5, [], True, True, [long, long]), ("d", 1, [], False, False, [long]), ("e", 5, [], True, True, [long, "  short  "]), ("e", 1, [], False, False, ["any"]),
            ("f", 5, [], True, True, [long, None]), ("f", 1, ["gate"], False, False, [long]), ("g", 5, ["gate"], True, True, [long]), ("g", 2, [], False, False, [long]), ("g", 1, ["gate"], False, False, [long])]
    df = spark.createDataFrame(rows, "id string, preference int, errors array<string>, is_baseline boolean, is_native boolean, pages array<string>")
    assert {(r["id"], r["preference"]) for r in documents.native_first(df).collect()} == {("d", 5), ("e", 1), ("f", 5), ("g", 2)}
