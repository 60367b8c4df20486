"""Operators on small hand-made tables: expectations of the fixtures and edge cases."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant import schemas
from sextant.functions import scoring as M
from sextant.functions import text as X
from sextant.operators import catalog, citations, documents, evaluation, exports, graph, mapping, search, segments, state
from sextant.operators import intent as Q
from sextant.sources import files
from sextant.streaming import history


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


# --- queries and intent ---


def test_intent_reads_identifiers():
    assert Q.parse("Act No. 9 of 2023") == {"act_number": ("9", 2023)}
    assert Q.parse("section 34(2)(a)") == {"section": "34(2)(a)"} and Q.parse("Sec. 7A") == {"section": "7A"}
    assert Q.parse("Judicature Act") == {"act_title": "judicature act"}
    assert Q.parse("the Anti-Corruption Act, No. 9 of 2023") == {"act_number": ("9", 2023), "act_title": "anti corruption act"}
    assert Q.parse("amendments that repeal") == {"relationship": "REPEALS"}
    for bad in ("Act No. of 2023", "section", "", "   ", None):
        assert Q.parse(bad) == {}


def test_named_rows_match_at_every_level(spark):
    acts = spark.createDataFrame([(1, "9", 2023, "levy act", "3", "3"), (2, "9", 2023, "levy act", "4", "4(1)"), (3, None, None, None, "3", None)], "id int, act_number string, year int, normalized_title string, section_number string, section_path string")
    hits = lambda q: {r["id"] for r in acts.where(Q.exact_section(Q.parse(q))).collect()}
    assert hits("Act No. 9 of 2023") == {1, 2} and hits("section 3") == {1, 3} and hits("section 4(1) of Act No. 9 of 2023") == {2}
    assert hits("levy act") == {1, 2} and hits("section 3 No. 8 of 2023") == set() and hits("repeal") == set()


def test_guards():
    assert Q.guard("  x ", 1000, -3) == ("x", 100, 0)
    with pytest.raises(ValueError):
        Q.guard("can I sue them")
    with pytest.raises(ValueError):
        Q.guard("x" * 201)


# --- text ---


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (X.search_form, "  Héllo-World 9 ", "h llo world 9"), (X.act_title_form, "Judicature Act, No. 2 of 1978", "judicature act"), (X.act_number, "no 12a", "12A"), (X.year, "of 1999.", 1999),
        (X.chapter, "see chapter 218a here", "Chapter 218A"), (X.section_number, "Section 9 A", "9A"), (X.section_number, "paragraph (B)", "(b)"), (X.schedule, "the first schedule", "First Schedule"),
        (X.target_path, "Part iv of it", "Part IV"), (X.target_path, "SUBSECTION  (2)", "subsection (2)"), (X.cited_name, "of the Levy Act; The Social Security Act", "Social Security Act"), (X.cited_name, "the Code", None),
        (X.relationship_word, "Cross-Reference", "CROSS_REFERENCE"), (X.relationship_word, "nothing", None), (X.csv_safe, "=1+1", "'=1+1"), (X.csv_safe, "a=1", "a=1"),
        (X.classify_relationship, "is hereby repealed", "REPEALS"), (X.classify_relationship, "see section 2", "REFERS_TO"), (X.classify_relationship, "none", "UNKNOWN"), (X.type_label, "CROSS_REFERENCE", "Cross reference"),
        (X.clean, "a-\nb  c\r\n\n\n\nd\nPage 3 of 9\n", "ab c\n\nd"), (X.nfkc, "ﬁ Ⅷ", "fi VIII"), (X.markdown_to_text, "# **Title** [x](y)\n| a | b |", "Title x\n a b "),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_text_functions_of_null(spark):
    null = F.lit(None).cast("string")
    for f in (X.act_number, X.chapter, X.section_number, X.schedule, X.target_path, X.cited_name, X.relationship_word, X.csv_safe, X.nfkc):
        assert one(spark, f(null)) is None
    assert one(spark, X.search_form(null)) == "" and one(spark, X.squeeze(null)) == ""


def test_loose_dates(spark):
    assert str(one(spark, X.loose_date(F.lit("12th January 2020")))) == "2020-01-12"
    assert str(one(spark, X.loose_date(F.lit("3 Feb 1999")))) == "1999-02-03"
    assert one(spark, X.loose_date(F.lit("soon"))) is None


def test_fuzzy_ratio(spark):
    assert one(spark, X.fuzzy_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


# --- vectors and fusion ---


def test_cosine_and_scores(spark):
    q = M.as_vector([1.0, 0.0])
    for v, distance in (([1.0, 0.0], 0.0), ([0.8, 0.6], 0.2), ([0.0, 1.0], 1.0), ([], 1.0), ([0.0, 0.0], 1.0), ([1.0], 1.0)):
        assert one(spark, M.cosine_distance(F.array(*map(F.lit, v)).cast("array<double>"), q)) == pytest.approx(distance)
    assert one(spark, M.cosine_distance(F.lit(None).cast("array<double>"), q)) == 1.0
    for d, s in ((0.0, 100.0), (0.2, 80.0), (1.0, 0.0), (1.5, 0.0)):
        assert one(spark, M.similarity_score(F.lit(d))) == s


def test_nearest_puts_exact_first(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], True), (3, [0.8, 0.6], False)], "section_id int, embedding array<double>, hit boolean")
    assert [r.section_id for r in search.nearest(df, [1.0, 0.0], 3, exact=F.col("hit")).collect()] == [2, 1, 3]
    assert search.nearest(df.limit(0), [1.0, 0.0], 3).count() == 0


def fuse(spark, kw, sem, **kwargs):
    schema = "rank int, result_type string, id string"
    a = spark.createDataFrame([(k + 1, "ACT", x) for k, x in enumerate(kw)], schema)
    b = spark.createDataFrame([(k + 1, "ACT", x) for k, x in enumerate(sem)], schema)
    return [(r.id, r.score) for r in search.fused_page(search.fuse(a, b, **kwargs), 100).collect()]


def test_fusion(spark):
    got = fuse(spark, ["a", "b", "a"], ["b", "c"])
    assert got == [("b", pytest.approx(1 / 62 + 1 / 61)), ("a", pytest.approx(1 / 61)), ("c", pytest.approx(1 / 62))]
    assert fuse(spark, ["a"], ["a"], k=10, weights=(2.0, 0.5))[0][1] == pytest.approx(2.5 / 11)
    assert fuse(spark, [], []) == []


@settings(max_examples=8, deadline=None)
@given(kw=st.lists(st.sampled_from("abcdef"), max_size=6), sem=st.lists(st.sampled_from("abcdef"), max_size=6))
def test_fusion_matches_model(spark, kw, sem):
    want = {x: sum(1 / (61 + ys.index(x)) for ys in (kw, sem) if x in ys) for x in {*kw, *sem}}
    assert fuse(spark, kw, sem) == [(x, pytest.approx(s, abs=1e-8)) for x, s in sorted(want.items(), key=lambda p: (-round(p[1], 9), p[0]))]


def test_modes():
    assert search.mode("all", True, "x") == "hybrid"
    assert search.mode("all", True, "x", relationship="AMENDS") == "keyword"
    assert search.mode("all", False, "x") == "keyword" and search.mode("semantic", False, "") == "semantic"


# --- keyword search over the fixture corpus ---


@pytest.fixture(scope="module")
def corpus(spark):
    acts = spark.createDataFrame(
        [
            ("a1", "Judicature Act", "judicature act", "2", 1978, "Courts", "Parliament", "j.pdf", "Judicature Act body text and court jurisdiction.", "PROCESSED"),
            ("a2", "Social Security Contribution Levy Act", "social security contribution levy act", "25", 2022, "Tax", "Parliament", "l.pdf", "Contribution levy body text.", "VERIFIED"),
            ("a3", "Draft Pending Act", "draft pending act", "99", 2026, "Draft", None, "d.pdf", "Pending administrative text.", "UPLOADED"),
        ],
        "id string, title string, normalized_title string, act_number string, year int, category string, source_name string, source_file_name string, raw_text string, processing_status string",
    )
    sections = spark.createDataFrame(
        [("s1", "a1", "9", "9", "High Court jurisdiction", "jurisdiction of the high court", 1, "VERIFIED"), ("s2", "a1", "10", "10", "Pending procedure", "pending procedure", 2, "PENDING"), ("s3", "a2", "4", "4", "Tax liability", "liability to levy", 1, "VERIFIED")],
        "id string, act_id string, section_number string, section_path string, heading string, text string, sort_order int, verification_status string",
    ).withColumn("normalized_text", F.col("text"))
    ref = "id string, source_act_id string, raw_reference_text string, context_snippet string, relationship_type string, target_act_title_raw string, target_act_number string, target_act_year int, target_section_number string, target_section_path string, target_act_id string, target_section_id string, confidence_score double, verification_status string"
    refs = spark.createDataFrame(
        [
            ("r1", "a2", "amends section 9", "levy amends", "AMENDS", None, None, None, "9", None, "a1", "s1", 0.95, "VERIFIED"),
            ("r2", "a2", "adds schedule", "levy adds", "ADDS", None, None, None, None, "First Schedule", None, None, 0.5, "NEEDS_REVIEW"),
            ("r3", "a1", "repeals", "x", "REPEALS", None, None, None, None, None, None, None, 0.4, "PENDING"),
        ],
        ref,
    )
    return acts, sections, refs


def ids(df):
    return [r.id for r in search.page(df, 10).collect()]


def test_keyword_search(corpus):
    acts, sections, refs = corpus
    assert ids(search.act_hits(acts, "Judicature Act", "GENERAL_USER"))[0] == "a1"
    assert search.act_hits(acts, "Judicature Act", "ADMIN").where("id = 'a1'").first()["score"] == pytest.approx(0.3 + 9.0 + 0.8 + 200)
    assert ids(search.act_hits(acts, "pending", "LAWYER")) == [] and ids(search.act_hits(acts, "pending", "ADMIN")) == ["a3"]
    assert ids(search.section_hits(sections, acts, "9", "GENERAL_USER")) == ["s1"]
    assert ids(search.section_hits(sections, acts, "pending", "GENERAL_USER")) == [] and ids(search.section_hits(sections, acts, "pending", "LAWYER")) == ["s2"]
    assert ids(search.reference_hits(refs, acts, "", "LAWYER", relationship="AMENDS")) == ["r1"]
    assert ids(search.reference_hits(refs, acts, "", "LAWYER", mapped="unresolved")) == ["r2", "r3"]
    assert ids(search.reference_hits(refs, acts, "", "GENERAL_USER")) == ["r1"]
    both = search.union_hits(search.act_hits(acts, "levy", "LAWYER"), search.section_hits(sections, acts, "levy", "LAWYER"))
    assert {(r.result_type, r.n) for r in search.counts(both).collect()} == {("ACT", 1), ("SECTION", 1)}
    assert search.page(both, 1, 1).count() == 1


# --- graph ---


def test_graph(spark):
    refs = spark.createDataFrame([(1, 2, "AMENDS", "VERIFIED"), (1, 2, "AMENDS", "PENDING"), (2, 1, "REPEALS", "VERIFIED"), (1, 1, "AMENDS", "VERIFIED"), (1, None, "ADDS", "REJECTED")], "source long, target long, relationship string, verification_status string")
    e = graph.edges(refs)
    assert {tuple(r) for r in e.collect()} == {(1, 2, "AMENDS", 2, True), (2, 1, "REPEALS", 1, False)}
    assert {(r.label, r.offset) for r in graph.pair_offsets(e).collect()} == {("AMENDS", -0.5), ("REPEALS", 0.5)}
    assert {tuple(r) for r in graph.neighbours(e).collect()} == {(1, 1, 3), (2, 1, 3)}
    row = graph.linked_acts(e, 1).first()
    assert (row.counterpart, row.total, row.pending, [tuple(x) for x in row.by_type]) == (2, 3, True, [("AMENDS", 2), ("REPEALS", 1)])
    s = graph.summary(refs, 1).first()
    assert (s.total, s.outgoing, s.incoming, s.mapped, s.unresolved) == (5, 4, 1, 4, 1)
    assert s.by_type == {"AMENDS": 3, "REPEALS": 1, "ADDS": 1} and s.by_status == {"VERIFIED": 3, "PENDING": 1, "REJECTED": 1}
    assert graph.edges(refs.limit(0)).count() == 0


def test_dossier_families(spark):
    schema = "focus string, source_act_id string, target_act_id string, relationship_type string, verification_status string, direction string, target_act_title_raw string, raw_reference_text string, target_act_number string, target_act_year int"
    rows = [
        ("f", "f", "t", "AMENDS", "VERIFIED", "outgoing", None, "x", None, None), ("f", "f", "t", "SUBSTITUTES", "PENDING", "outgoing", None, "x", None, None), ("f", "t", "f", "REPEALS", "VERIFIED", "incoming", None, "x", None, None),
        ("f", "f", None, "ADDS", "VERIFIED", "outgoing", None, "paragraph (a) thereof", None, None), ("f", "f", None, "ADDS", "VERIFIED", "outgoing", "Missing Levy Act", "section 2", None, None), ("f", "f", None, "ADDS", "VERIFIED", "outgoing", None, "gone", "4", 1999),
    ]
    got = {(r.family, r.counterpart, r.label): (r.n, r.pending, r.types) for r in graph.dossier(spark.createDataFrame(rows, schema)).collect()}
    assert got[("amends", "t", None)] == (2, True, "AMENDS,SUBSTITUTES") and got[("incoming", "t", None)][0] == 1 and got[("internal", "f", None)][0] == 1
    assert ("unresolved", None, "Missing Levy Act") in got and ("unresolved", None, "Act No. 4 of 1999") in got


# --- evaluation ---


def test_set_metrics(spark):
    g = spark.createDataFrame([("5", "AMENDS"), ("7", "REPEALS"), ("7", "REPEALS")], "s string, t string")
    p = spark.createDataFrame([("5", "AMENDS"), ("9", "REFERS_TO")], "s string, t string")
    assert tuple(evaluation.set_metrics(g, p, ["s", "t"]).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(evaluation.set_metrics(g.limit(0), p.limit(0), ["s", "t"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    e, d = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (3,), (4,)], "k int")
    assert evaluation.segmentation_accuracy(e, d, "k").first()[0] == 0.6667 and evaluation.segmentation_accuracy(e.limit(0), d, "k").first()[0] is None


def test_ranking_metrics(spark):
    got = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("r", "z", 1)], "query_id string, item string, rank int")
    grades = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, item string, grade int")
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    m = {r.query_id: r for r in evaluation.ranking_metrics(got, grades, queries).collect()}
    assert (m["q"].p5, m["q"].r10, m["q"].mrr) == (0.4, 1.0, 1.0) and m["q"].ndcg10 == pytest.approx(3.5 / (3 + 1 / 1.584962500721156), abs=1e-6)
    assert (m["s"].ndcg10, m["s"].r10, m["s"].zero_result) == (1.0, 1.0, True) and (m["r"].ndcg10, m["r"].r5) == (0.0, 1.0)
    agg = evaluation.aggregate_metrics(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, False, 1, 1, x) for x in (10.0, 20.0, 100.0)], "p5 double, r5 double, r10 double, mrr double, ndcg10 double, zero_result boolean, verified int, retrieved int, latency_ms double")).first()
    assert (agg.median_ms, agg.p95_ms, agg.verified_rate) == (20.0, 100.0, 1.0)


# --- mapping ---


def sequential(rows):
    """The fold that the window replaces."""
    context, out = None, []
    for own, principal, bare, locked in rows:
        used = not locked and (principal or bare) and context is not None
        resolved = own if locked else context if used else own
        out.append(resolved)
        if resolved is not None and not used and not principal:
            context = resolved
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 3)), st.booleans(), st.booleans(), st.booleans()), max_size=9))
def test_context_window_equals_fold(spark, rows):
    rows = [(None if b and not lk else o, p, b, lk) for o, p, b, lk in rows]  # a bare reference names no act
    df = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "act string, pos int, own int, principal boolean, bare boolean, locked boolean")
    got = [r.resolved for r in mapping.resolve_context(df, "act", "pos", locked="locked").orderBy("pos").collect()]
    assert got == sequential(rows)


def test_map_references(spark):
    acts = spark.createDataFrame([("a1", "judicature act", "2", 1978, None), ("a2", "levy act", "25", 2022, "Chapter 218"), ("a3", "social security levy act", "9", 2000, None), ("a4", "poisons opium and drugs ordinance", "1", 1930, None)], "id string, normalized_title string, act_number string, year int, source_name string")
    sections = spark.createDataFrame([("s9", "a1", "9", "9", "SECTION", "h", "t"), ("sc", "a2", "First Schedule", "First Schedule", "SCHEDULE", "First Schedule", "t")], "id string, act_id string, section_number string, section_path string, section_type string, heading string, text string")
    schema = "id string, source_act_id string, position int, raw_reference_text string, relationship_type string, target_act_title_raw string, target_act_number string, target_act_year int, target_section_number string, target_section_path string, target_act_id string, target_section_id string, verification_status string"
    r = lambda i, raw="Section 9", t=None, n=None, y=None, s=None, p=None, act=None, st_="PENDING", d="d": (i, d, int(i), raw, "AMENDS", t, n, y, s, p, act, None, st_)
    refs = [
        r("1", t="Judicature Act, No. 2 of 1978", s="9"), r("2", s="9"), r("3", t="Levy Act", p="First Schedule"), r("4", t="principal enactment"), r("5", n="77", y=1999, t="Judicature Act"),
        r("6", t="opium and drugs ordinance", d="e"), r("7", t="Chapter 218", d="e"), r("8", raw="nothing", d="g"), r("9", act="a3", st_="VERIFIED", d="h"), r("10", s="1", d="h"),
    ]
    m = {x.id: x for x in mapping.map_references(spark.createDataFrame(refs, schema), acts, sections).collect()}
    assert {k: v.resolved for k, v in m.items()} == {"1": "a1", "2": "a1", "3": "a2", "4": "a2", "5": None, "6": "a4", "7": "a2", "8": None, "9": "a3", "10": "a3"}
    assert (m["1"].section, m["1"].confidence, m["2"].match, m["2"].confidence, m["3"].section) == ("s9", 0.98, "inferred", 0.78, "sc")
    assert m["6"].match == "partial" and m["8"].confidence == 0.35 and m["5"].needs_review and m["10"].used_context
    assert mapping.mapping_summary(spark.createDataFrame(refs, schema).transform(lambda x: mapping.map_references(x, acts, sections))).first()["mapped_acts"] == 8


# --- documents ---

TEXT = """PARLIAMENT OF THE DEMOCRATIC SOCIALIST REPUBLIC
JUDICATURE ACT, No. 2 of 1978
Be it enacted as follows:

Short title
1. This Act may be cited as the Judicature Act.
2. Section 9 of the Levy Act, No. 25 of 2022 is hereby amended in section 3 thereof.
PART II
3. Nothing in item 4 here.
FIRST SCHEDULE
1. not a section
"""


def test_segments(spark):
    df = spark.createDataFrame([("d", TEXT), ("e", "No numbers here."), ("n", None), ("z", "")], "id string, raw_text string")
    rows = segments.segment(df).orderBy("id", "sort_order").collect()
    assert [(r.section_number, r.section_type) for r in rows if r.id == "d"] == [("PREAMBLE", "PREAMBLE"), ("1", "SECTION"), ("2", "SECTION"), ("PART II", "PART"), ("3", "SECTION"), ("FIRST SCHEDULE", "SCHEDULE")]
    first = next(r for r in rows if r.section_number == "1")
    assert first.text.startswith("Short title") and TEXT[first.source_start : first.source_end].strip() == first.text
    assert [(r.id, r.section_number, r.section_type) for r in rows if r.id != "d"] == [("e", "0", "OTHER"), ("n", "0", "OTHER"), ("z", "0", "OTHER")]


def test_extracted_references(spark):
    df = spark.createDataFrame([("d", "Section 9 of the Judicature Act, No. 2 of 1978 is hereby amended. See section 12 here. The item 4 under section 5."), ("n", None)], "id string, text string")
    rows = citations.extract_references(df).collect()
    first = rows[0]
    assert (first.relationship_type, first.target_act_number, first.target_act_year, first.target_section_number, first.confidence_score) == ("AMENDS", "2", 1978, "9", 0.95)
    assert first.target_act_title_raw == "Judicature Act" and all("section 12" not in r.raw_reference_text for r in rows)
    assert {r.target_section_number for r in rows if r.relationship_type == "CROSS_REFERENCE"} == {"4", "5"}


def test_metadata(spark):
    df = spark.createDataFrame([("d", "Gazette printed\nNATIONAL LEVY ACT, No. 10 of 2020\n[Certified on 12th January 2020]", "x_y.pdf"), ("n", None, "my_file.pdf")], "id string, raw_text string, source_file_name string")
    m = {r.id: r for r in documents.metadata(df).collect()}
    assert (m["d"].title, m["d"].act_number, m["d"].year, str(m["d"].certification_date)) == ("National Levy Act", "10", 2020, "2020-01-12")
    assert m["n"].title == "my file" and m["n"].confidence == 0.35


def test_pages_and_sources(spark):
    pages = spark.createDataFrame([("d", 1, "abcd"), ("d", 2, "efg")], "id string, page_number int, text string")
    spans = documents.page_spans(pages)
    assert [(r.start, r.end) for r in spans.orderBy("page_number").collect()] == [(0, 4), (6, 9)]
    s = spark.createDataFrame([("d", 2, 7), ("d", 4, 6)], "id string, source_start int, source_end int")
    assert {(r.page_start, r.page_end) for r in documents.section_pages(s, spans).collect()} == {(1, 2), (None, None)}
    c = spark.createDataFrame([("d", 1, False, ["x"]), ("d", 2, False, []), ("d", 3, True, []), ("e", 1, False, ["x"]), ("e", 2, True, ["y"])], "id string, preference int, is_baseline boolean, errors array<string>")
    assert {(r.id, r.preference) for r in documents.better_source(c).collect()} == {("d", 2), ("e", 2)}
    assert one(spark, documents.quality_errors(F.lit(10), F.lit(1), F.lit(0), F.lit(0), F.lit(1), F.lit(0))) == ["text_density", "sections"]


def test_merge_extractions(spark):
    schema = "reference_key string, confidence_score double, extraction_method string, verification_status string, target string"
    a = spark.createDataFrame([("k1", 0.9, "REGEX", "PENDING", None), ("k2", 0.3, "REGEX", "PENDING", "x")], schema)
    b = spark.createDataFrame([("k1", 0.6, "LLM", "PENDING", "t"), ("k3", 0.7, "LLM", "PENDING", "u"), ("k4", 0.4, "LLM", "PENDING", "v")], schema)
    got = {r.reference_key: (r.confidence_score, r.extraction_method, r.verification_status, r.target) for r in documents.merge_extractions(a, b).collect()}
    assert got == {"k1": (0.98, "LLM", "PENDING", "t"), "k2": (0.3, "REGEX", "PENDING", "x"), "k3": (0.7, "LLM", "NEEDS_REVIEW", "u")}


# --- state, catalogue, files ---


def test_state(spark):
    jobs = spark.createDataFrame([("a", "RUNNING", datetime(2024, 1, 1)), ("b", "RUNNING", datetime(2024, 1, 2)), ("c", "QUEUED", datetime(2020, 1, 1))], "act_id string, status string, created_at timestamp_ntz")
    out = state.expire_jobs(jobs, datetime(2024, 1, 2, 0, 10))
    assert {r.act_id: r.status for r in out.collect()} == {"a": "FAILED", "b": "RUNNING", "c": "QUEUED"}
    acts = spark.createDataFrame([("a", "PROCESSING"), ("b", "PROCESSING")], "id string, processing_status string")
    assert {r.id: r.processing_status for r in state.fail_acts(acts, out).collect()} == {"a": "FAILED", "b": "PROCESSING"}
    ev = spark.createDataFrame([(1, "A", datetime(2024, 1, 1), 1), (1, "A", datetime(2024, 1, 1), 2), (2, "A", datetime(2023, 1, 1), 3)], "u int, k string, at timestamp_ntz, id int")
    assert {(r.u, r.id) for r in state.latest(ev, ["u", "k"], "at", "id").collect()} == {(1, 2), (2, 3)}


def test_backfill(spark):
    row = lambda i, status, h="h": (i, "t", [1.0] if status == "READY" else None, status, "p", "m", 1, h)
    s = spark.createDataFrame([row("1", "READY"), row("2", "READY", "old"), row("3", "PENDING"), row("4", "FAILED")], "id string, text string, embedding array<float>, embedding_status string, embedding_provider string, embedding_model string, embedding_dimension int, embedding_source_hash string")
    embed = F.when(F.col("id") == "3", F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(2.0))).cast("array<float>")
    got = {r.id: (r.embedding_status, r.embedding) for r in state.backfill(s, embed, "p", "m", 1, F.lit("h")).collect()}
    assert got == {"1": ("READY", [1.0]), "2": ("READY", [2.0]), "3": ("FAILED", None), "4": ("FAILED", None)}
    assert {r.id for r in state.mark_stale(s, "p", "m", 1, F.lit("h")).where("embedding_status = 'STALE'").collect()} == {"2"}
    st_ = catalog.embedding_status(s, "p", "m", 1).first()
    assert (st_.total, st_.ready, st_.pending, st_.failed, st_.is_ready, st_.reasons) == (4, 2, 1, 1, False, ["pending", "failed"])


def test_delete_guards(spark):
    refs = spark.createDataFrame([("a", "b")], "source_act_id string, target_act_id string")
    jobs = spark.createDataFrame([("c", "RUNNING")], "act_id string, status string")
    for act in ("b", "c"):
        with pytest.raises(ValueError):
            state.delete_act(act, {}, refs, jobs)


def test_warnings_at_any_depth(spark):
    jobs = spark.createDataFrame([(1, '{"warnings":["a","b"],"x":{"errors":["b","c"],"y":[{"warnings":"d"}]},"z":"no"}'), (2, "{}")], "id int, summary_json string")
    assert sorted((r.id, r.message) for r in catalog.warning_messages(jobs).collect()) == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]


def test_uploads_and_gold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.pdf", b"no"), ("d.txt", b"%PDF-2"), ("e.pdf", b"%PDF-known")):
        (tmp_path / "in" / name).write_bytes(body)
    import hashlib

    known = spark.createDataFrame([(hashlib.sha256(b"%PDF-known").hexdigest(),)], "file_sha256 string")
    assert [r.source_file_name for r in files.uploads(spark, str(tmp_path / "in"), known).collect()] == ["a.pdf"]
    head = ",".join(schemas.GOLD.names)
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text(f"{head}\nq1,x,t,d.pdf,4,2,a;b,final,\nq1,x,t,d.pdf,5,1,a,final,\n")
    bad.write_text(f"{head}\nq1,x,t,d.pdf,4,7,a,final,\n")
    rows = files.gold(spark, str(good))
    assert files.grade_maps(rows).first()["grades"] == {"4": 2, "5": 1}
    with pytest.raises(ValueError):
        files.gold(spark, str(bad))


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), (None, 2)], "b string, a int")
    made = exports.artifact(df, ["b", "a"])
    assert {r.payload for r in made.collect()} == {'{"a":1,"b":"x"}', '{"a":2,"b":null}'}
    assert exports.write_artifacts(made, str(tmp_path / "art")).count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(1, "A", datetime(2024, 1, 1, k)) for k in range(4)] + [(2, "A", datetime(2024, 1, 1))], "u int, k string, viewed_at timestamp")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    history.run_once(history.latest_views(stream, ["u", "k"]), "views", str(tmp_path / "ck"))
    assert {(r.u, r.views) for r in spark.table("views").collect()} == {(1, 4), (2, 1)}


# --- whole plans ---


def test_hybrid_search(spark, corpus):
    from sextant.plans import hybrid

    acts, sections, refs = corpus
    vectors = spark.createDataFrame([("s1", [1.0, 0.0]), ("s3", [0.0, 1.0])], "id string, embedding array<double>")
    s = sections.join(vectors, "id", "left")
    mode, page = hybrid.search_page(acts, s, refs, "levy", "LAWYER", vector=[0.0, 1.0])
    rows = page.collect()
    assert mode == "hybrid" and rows[0].id == "s3"
    mode, page = hybrid.search_page(acts, s, refs, "section 9", "GENERAL_USER", "semantic", vector=[0.0, 1.0])
    assert mode == "semantic" and [r.id for r in page.collect()] == ["s1", "s3"]
    mode, page = hybrid.search_page(acts, s, refs, "", "LAWYER", relationship="AMENDS")
    assert mode == "keyword" and [r.id for r in page.collect()] == ["r1"]
    mode, page = hybrid.search_page(acts, s, refs, "levy", "LAWYER", year=1978)
    assert mode == "keyword" and page.count() == 0
    with pytest.raises(ValueError):
        hybrid.search_page(acts, s, refs, "x", requested="semantic")


def test_ingest(spark):
    from sextant.plans import ingest

    texts = spark.createDataFrame([("a", "a.pdf", TEXT), ("b", "levy_act.pdf", "Levy Act, No. 25 of 2022\n1. First.\n3. Third."), ("n", "n.pdf", None)], "id string, source_file_name string, raw_text string")
    out = ingest.ingest(texts)
    refs = out.references.where("target_act_number = '25'").collect()
    # two strong patterns meet: the amended section, and the act by its name and number
    assert sorted(r.raw_reference_text for r in refs) == ["Section 9 of the Levy Act, No. 25 of 2022", "Section 9 of the Levy Act, No. 25 of 2022 is hereby amended"]
    assert {(r.target_act_id, r.relationship_type) for r in refs} == {("b", "AMENDS")}
    assert {r.id for r in out.acts.collect()} == {"a", "b", "n"}
    assert out.sections.where("act_id = 'b' AND section_type = 'SECTION'").count() == 2


def test_hash_embedding(spark):
    from sextant.functions.embedding import hash_provider

    rows = spark.createDataFrame([("A  b",), ("a b",), ("c",), (" ",), (None,)], "t string").select(hash_provider(40)(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v != rows[2].v and sum(x * x for x in rows[2].v) == pytest.approx(1) and set(rows[3].v) == set(rows[4].v) == {0.0}


def test_model_payload(spark):
    from sextant.functions.payload import references_of_payload

    ok = '{"references":[{"raw_text":"section 5 of it","relationship":"amends","target_section_number":"5","confidence":3},{"raw_text":"Act No. 9","target_act_number":"9"}]}'
    rows = [("a", "see section 5 here", ok), ("b", "x", '{"references":[{"raw_text":"abc","relationship":"LIKES"}]}'), ("c", "x", "not json"), ("d", "x", None), ("e", None, '{"references":[]}')]
    got = references_of_payload(spark.createDataFrame(rows, "id string, text string, payload string")).collect()
    assert [(r.id, r.relationship_type, r.target_section_number, r.confidence_score) for r in got] == [("a", "AMENDS", "5", 1.0)]


def test_workspace(spark, corpus):
    acts, sections, refs = corpus
    items = spark.createDataFrame([(1, "ACT", "a1", None, None), (2, "SECTION", None, "s3", None), (3, "REFERENCE", None, None, "r1"), (4, "ACT", "gone", None, None)], "item int, item_type string, act_id string, section_id string, reference_id string")
    got = {r.item: (r.of_act, r.title, r.status) for r in catalog.saved_items(items, acts, sections, refs).collect()}
    assert got == {1: ("a1", "Judicature Act", "PROCESSED"), 2: ("a2", "Section 4 Tax liability", "VERIFIED"), 3: ("a2", "amends section 9", "VERIFIED"), 4: ("gone", "Saved item", None)}
    seen = spark.createDataFrame([("a1", None), ("a2", "s3")], "act_id string, section_id string")
    assert {r.href for r in catalog.history_links(seen, acts, sections).collect()} == {"/acts/a1", "/sections/s3"}
    acts2 = spark.createDataFrame([("a", "k1"), ("b", None)], "id string, extraction_artifact_key string")
    jobs = spark.createDataFrame([("a", 2, '{"artifact_key":"k2"}'), ("a", 1, '{"artifact_key":"k1"}'), ("a", 3, "{}")], "act_id string, created_at int, summary_json string")
    assert {r.id: r["keys"] for r in exports.pointers(acts2, jobs).collect()} == {"a": ["k1", "k2"], "b": []}
    cited = refs.withColumn("source_section_id", F.lit(None).cast("string"))  # a column of references that the fixture leaves out
    rows = graph.relationship_rows(cited, acts, sections, F.lit("a2")).where("id = 'r1'").first()
    assert (rows.source_act_title, rows.target_act_title, rows.target_section_label, rows.direction, rows.mapped) == ("Social Security Contribution Levy Act", "Judicature Act", "9", "outgoing", True)


def test_gold_resolution(spark):
    acts = spark.createDataFrame([("a", "d.pdf")], "id string, source_file_name string")
    sections = spark.createDataFrame([("s1", "a", "4"), ("s2", "a", "5"), ("s3", "a", "5")], "id string, act_id string, section_path string")
    gold = spark.createDataFrame([("q", "d.pdf", "4"), ("q", "d.pdf", "5"), ("q", "d.pdf", "6")], "query_id string, document_identifier string, expected_section_path string")
    ok, bad = evaluation.resolve_gold(gold, sections, acts)
    assert [r.section_id for r in ok.collect()] == ["s1"]
    assert {(r.expected_section_path, r.sections) for r in bad.collect()} == {("5", 2), ("6", 0)}
