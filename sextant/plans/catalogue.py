"""The registered queries of the engine, each over its whole tables, and their DuckDB counterparts.

Keys follow the operator inventory; the comment above a query names what it covers.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant import schemas
from sextant.functions import embedding, payload, stems
from sextant.functions import scoring as M
from sextant.functions import text as X
from sextant.operators import catalog, cells, citations, documents, evaluation, exports, fulltext, fuzzy, graph, mapping, merge, rows, search, segments, state
from sextant.operators import intent as Q
from sextant.operators import visibility as V
from sextant.plans import backfill, hybrid
from sextant.sources import bindings as T
from sextant.sources import storage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# The bindings of sextant.sources.bindings in SQL.
ACTS = """acts AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, (doc_id % 50)::VARCHAR AS act_number, (1978 + doc_id % 48)::INTEGER AS year, source AS category, lang, text AS raw_text,
  CASE quality WHEN 1 THEN 'VERIFIED' WHEN 0 THEN 'PROCESSED' ELSE 'UPLOADED' END AS processing_status FROM documents LEFT JOIN labels USING (doc_id))"""
SECTIONS = """sections AS (SELECT conv_id AS act_id, turn AS sort_order, role AS heading, text,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS verification_status FROM conversations)"""
REFS = """refs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS source, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 10 END AS target,
  CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'N' THEN 'REFERS_TO' ELSE 'REPEALS' END AS relationship,
  CASE l_linestatus WHEN 'F' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS verification_status, l_discount * 10 AS confidence, l_shipdate AS created_at FROM lineitem)"""
EDGES = REFS + """, edges AS (SELECT source, target, relationship AS label, count(*) AS n, bool_or(verification_status <> 'VERIFIED') AS pending
  FROM refs WHERE target IS NOT NULL AND source <> target GROUP BY ALL)"""
VECTORS = "vecs AS (SELECT vec_id AS section_id, label AS act_id, embedding::DOUBLE[] AS embedding FROM embeddings)"
FORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- filters ---------------------------------------------------------------------------------


# FLT-01, FLT-20, SRC-01
@query(f"WITH {ACTS} SELECT id, year, processing_status FROM acts WHERE processing_status IN ('PROCESSED', 'VERIFIED')")
def flt_role_visibility(spark, d):
    return T.acts(spark, d).where(V.acts("LAWYER", F.col("processing_status"))).select("id", "year", "processing_status")


# FLT-02, FLT-27
@query(f"WITH {SECTIONS} SELECT act_id, sort_order FROM sections WHERE verification_status = 'VERIFIED'")
def flt_section_visibility(spark, d):
    return T.sections(spark, d).where(V.sections("GENERAL_USER", F.col("verification_status"))).select("act_id", "sort_order")


# FLT-03, FLT-26
@query(f"WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source FROM refs WHERE verification_status = 'VERIFIED' AND target IS NOT NULL")
def flt_reference_visibility(spark, d):
    r = T.references(spark, d)
    return r.where(V.references("GENERAL_USER", F.col("verification_status"), F.col("target").isNotNull())).select("l_orderkey", "l_linenumber", "l_partkey", "source")


# FLT-05, FLT-22, FLT-23
@query(f"WITH {ACTS} SELECT id, title FROM acts WHERE year = 2001 AND category ILIKE '%src1%'")
def flt_metadata(spark, d):
    return T.acts(spark, d).where(V.metadata(year=2001, category="src1")).select("id", "title")


# FLT-06
@query(f"WITH {ACTS} SELECT id FROM acts WHERE title ILIKE '%the%' OR category ILIKE '%the%' OR raw_text ILIKE '%the%'")
def flt_ilike_or(spark, d):
    a = T.acts(spark, d)
    return a.where(search._any(*(search._like(c, "the") for c in ("title", "category", "raw_text")))).select("id")


# FLT-11
@query(f"WITH {SECTIONS} SELECT act_id, sort_order, verification_status FROM sections WHERE verification_status IN ('VERIFIED', 'PENDING', 'NEEDS_REVIEW')")
def flt_verified_pending(spark, d):
    return T.sections(spark, d).where(V.verification("verified_pending", F.col("verification_status"))).select("act_id", "sort_order", "verification_status")


# FLT-10, FLT-28
@query(f"WITH {REFS} SELECT count(*) FILTER (WHERE target IS NOT NULL) AS mapped, count(*) FILTER (WHERE target IS NULL) AS unresolved FROM refs")
def flt_mapped_unresolved(spark, d):
    m = F.col("target").isNotNull()
    return T.references(spark, d).agg(F.count_if(V.mapped_status("mapped", m)).alias("mapped"), F.count_if(V.mapped_status("unresolved", m)).alias("unresolved"))


# FLT-13
@query(f"WITH {REFS} SELECT relationship, count(*) AS n FROM refs WHERE source = 3 OR target = 3 GROUP BY 1")
def flt_scope_direction(spark, d):
    r = T.references(spark, d).withColumnsRenamed({"source": "source_act_id", "target": "target_act_id"})
    return r.where(V.scope(3, None)).groupBy("relationship").agg(F.count("*").alias("n"))


# FLT-24
@query(f"WITH {REFS} SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM refs GROUP BY 1")
def flt_confidence_band(spark, d):
    return T.references(spark, d).groupBy(M.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


# FLT-16
@query(f"WITH {ACTS} SELECT id FROM acts WHERE contains(lower(raw_text), '%%% o')")
def flt_literal_contains(spark, d):
    return T.acts(spark, d).where(V.contains_literal(F.col("raw_text"), "%%% O")).select("id")


# FLT-25
@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build')")
def flt_saved_text(spark, d):
    return catalog.text_filter(T.read(spark, d, "customer"), ["c_name", "c_mktsegment"], " Build ").select("c_custkey")


# FLT-17
@query(f"WITH {ACTS} SELECT id FROM acts WHERE list_has_all(regexp_split_to_array(lower(raw_text), '[^a-z0-9]+'), ['the', 'and', 'with'])")
def search_fulltext_all_terms(spark, d):
    return T.acts(spark, d).where(V.all_terms(F.col("raw_text"), "the and With")).select("id")


STEMMED = f"""WITH {ACTS}, said AS (SELECT id, unnest(regexp_split_to_array(lower(concat_ws(' ', title, category, raw_text)), '[^a-z0-9]+')) AS token FROM acts),
words AS (SELECT id, token FROM said WHERE token <> '' AND token NOT IN ({', '.join(f"'{w}'" for w in stems.STOP_WORDS)})), dictionary AS (SELECT DISTINCT token FROM words),
stemmed AS ({stems.stems_sql('dictionary')}), lexemes AS (SELECT id, lexeme FROM words JOIN stemmed USING (token))"""


# FLT-17: "ering" and "ered" have one stem
@query(STEMMED + " SELECT id, count(*) AS n FROM lexemes WHERE lexeme IN ('ere', 'ane', 'thing') GROUP BY 1 HAVING count(DISTINCT lexeme) = 3")
def search_stemmed(spark, d):
    path = storage.fresh_path(spark, "fulltext")
    fulltext.write_index(T.acts(spark, d), "id", ["title", "category", "raw_text"], path)
    return fulltext.search_index(spark, path, "The ering and aned of things")


# FLT-17: the whole index, as rows for each lexeme
@query(STEMMED + " SELECT lexeme, count(DISTINCT id) AS n_rows, count(*) AS n FROM lexemes GROUP BY 1")
def search_lexemes(spark, d):
    return fulltext.postings(T.acts(spark, d), "id", ["title", "category", "raw_text"]).groupBy("lexeme").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))


# --- search ----------------------------------------------------------------------------------

KEYWORD = f"""WITH {ACTS}, scored AS (SELECT 'ACT' AS result_type, id::VARCHAR AS id, title, {FORM.format('title')} AS form, raw_text, category, year, processing_status FROM acts
  WHERE processing_status IN ('PROCESSED', 'VERIFIED') AND ({FORM.format('title')} ILIKE '%the%' OR year::VARCHAR ILIKE '%the%' OR act_number ILIKE '%the%' OR category ILIKE '%the%' OR raw_text ILIKE '%the%')),
hits AS (SELECT result_type, id, title, raw_text, round(0.3::DOUBLE + CASE WHEN form = 'the' THEN 9.0::DOUBLE WHEN contains(form, 'the') THEN 5.5::DOUBLE ELSE 0 END
  + CASE WHEN contains({FORM.format('category')}, 'the') THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(raw_text), 'the') THEN 0.8::DOUBLE ELSE 0 END
  + CASE processing_status WHEN 'VERIFIED' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END, 6) AS score FROM scored)"""


def _keyword(spark, d):
    acts = T.acts(spark, d).withColumn("normalized_title", X.search_form(F.col("title")))
    return search.act_hits(acts, "the", "LAWYER")


# FLT-06, MTH-10, SRT-01, SRT-02
@query(KEYWORD + " SELECT result_type, id, title, score FROM hits ORDER BY score DESC, result_type, title, id LIMIT 20 OFFSET 5")
def search_keyword_page(spark, d):
    return search.page(_keyword(spark, d), 20, 5).select("result_type", "id", "title", "score")


# AGG-01, MTH-10 over all hits
@query(KEYWORD + " SELECT result_type, id, score FROM hits")
def search_keyword_scores(spark, d):
    return _keyword(spark, d).select("result_type", "id", "score")


# STR-14
@query(f"WITH {ACTS}, flat AS (SELECT id, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS t FROM acts) SELECT id, substr(t, greatest(1, strpos(lower(t), 'und') - 73), 220) AS snippet FROM flat")
def search_snippet(spark, d):
    return T.acts(spark, d).select("id", X.snippet(F.col("raw_text"), "und").alias("snippet"))


# SRT-13
@query(f"WITH {ACTS} SELECT id, title FROM acts WHERE contains(lower(title), 'an') ORDER BY title, id LIMIT 8")
def search_suggest(spark, d):
    return search.suggest(T.acts(spark, d), "an")


# SET-01, PRJ-01, AGG-01
@query(f"""WITH {ACTS}, {SECTIONS}, {REFS} SELECT result_type, count(*) AS n FROM (
  SELECT 'ACT' AS result_type FROM acts WHERE contains(lower(title), 'en') UNION ALL SELECT 'SECTION' FROM sections WHERE contains(lower(text), 'en')
  UNION ALL SELECT 'REFERENCE' FROM refs WHERE relationship = 'AMENDS') GROUP BY 1""")
def search_union_three_types(spark, d):
    a = T.acts(spark, d).where(V.contains_literal(F.col("title"), "en")).select(F.lit("ACT").alias("result_type"), "title")
    s = T.sections(spark, d).where(V.contains_literal(F.col("text"), "en")).select(F.lit("SECTION").alias("result_type"), "heading")
    r = T.references(spark, d).where("relationship = 'AMENDS'").select(F.lit("REFERENCE").alias("result_type"), "confidence")
    return search.counts(search.union_hits(a, s, r))


# SRT-04, MTH-02, MTH-03
def _probe(spark, d) -> list[float]:
    """The query vector: that of the least id (one row)."""
    return list(T.vectors(spark, d).orderBy("section_id").limit(1).first()["embedding"])


KNN = f"WITH {VECTORS}, q AS (SELECT embedding AS e FROM vecs ORDER BY section_id LIMIT 1), near AS (SELECT v.*, round(1 - greatest(-1, least(1, list_cosine_similarity(embedding, e))), 9) AS distance FROM vecs v, q)"


@query(KNN + " SELECT section_id, act_id, distance, round(greatest(1 - distance, 0) * 100, 2) AS score FROM near ORDER BY distance, section_id LIMIT 10 OFFSET 2")
def knn_topk(spark, d):
    return search.nearest(T.vectors(spark, d), _probe(spark, d), 10, 2).select("section_id", "act_id", "distance", "score")


# SRT-05, SRT-06, FLT-15
@query(KNN + " SELECT section_id, act_id, distance FROM near ORDER BY (act_id = 4) DESC, distance, section_id LIMIT 60")
def knn_exact_tier(spark, d):
    return search.nearest(T.vectors(spark, d), _probe(spark, d), 60, exact=F.col("act_id") == 4).select("section_id", "act_id", "distance")


# FLT-14
@query(KNN + " SELECT section_id, distance FROM near WHERE act_id = 3 ORDER BY distance, section_id LIMIT 10")
def knn_filtered(spark, d):
    return search.nearest(T.vectors(spark, d).where("act_id = 3"), _probe(spark, d), 10).select("section_id", "distance")


# SRT-04, FLT-14: the ten nearest of every vector whose id 20 divides, over cell lists; approximate, so no SQL (tests measure the recall)
@query()
def knn_cells(spark, d):
    path = storage.fresh_path(spark, "cells")
    v = T.vectors(spark, d)
    cells.write_cells(v, path)
    queries = v.where("section_id % 20 = 0").select(F.col("section_id").alias("query"), F.col("embedding").alias("vector"))
    return cells.join_cells(spark, path, queries, 10)


# FLT-14: a filter over cell lists; with every cell probed the search is exact
@query(KNN + " SELECT section_id, distance FROM near WHERE act_id = 3 ORDER BY distance, section_id LIMIT 10")
def knn_cells_filtered(spark, d):
    path = storage.fresh_path(spark, "cells")
    v = T.vectors(spark, d)
    cells.write_cells(v, path, cells=16)
    return cells.search_cells(spark, path, _probe(spark, d), 10, probes=16, where=F.col("act_id") == 3).select("section_id", "distance")


# MTH-03 over all rows
@query(KNN + " SELECT section_id, round(greatest(1 - distance, 0) * 100, 2) AS score FROM near")
def knn_score_clamp(spark, d):
    distance = F.round(M.cosine_distance(F.col("embedding"), M.as_vector(_probe(spark, d))), 9)
    return T.vectors(spark, d).select("section_id", M.similarity_score(distance).alias("score"))


# MTH-06
@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def vector_validity(spark, d):
    return T.read(spark, d, "embeddings").select("vec_id", M.valid_vector(F.col("embedding"), 64).alias("valid"))


def _lists(spark, d):
    c = T.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice", "o_orderkey")
    order = Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    kw = c.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).withColumn("rank", F.row_number().over(order))
    low = Window.orderBy("o_totalprice", "o_orderkey")
    sem = c.where("o_totalprice > 1000").orderBy("o_totalprice", "o_orderkey").limit(100).withColumn("rank", F.row_number().over(low))
    return kw.withColumn("result_type", F.lit("ACT")), sem.withColumn("result_type", F.lit("ACT"))


LISTS = """WITH kw AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 100),
sem AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders WHERE o_totalprice > 1000 QUALIFY rank <= 100)"""


# HYB-02, JOI-15, SET-02, MTH-01, SRT-03, SRT-07
@query(LISTS + """, a AS (SELECT id, min(rank) AS r FROM kw GROUP BY 1), b AS (SELECT id, min(rank) AS r FROM sem GROUP BY 1)
SELECT id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL OUTER JOIN b USING (id)""")
def rrf_fusion(spark, d):
    return search.fuse(*_lists(spark, d)).select("id", "score")


# WIN-01
@query(LISTS + " SELECT id, min(rank) AS first_rank FROM kw GROUP BY 1")
def rrf_dedupe_first_rank(spark, d):
    return search.first_ranks(_lists(spark, d)[0], ["id"], "first").select("id", F.col("first_rank").cast("bigint").alias("first_rank"))


# HYB-04: components of the fused page
@query(LISTS + """, a AS (SELECT id, min(rank) AS r FROM kw GROUP BY 1), b AS (SELECT id, min(rank) AS r FROM sem GROUP BY 1)
SELECT id, a.r AS keyword_rank, b.r AS semantic_rank, round(coalesce(2.0::DOUBLE / (10 + a.r), 0) + coalesce(0.5::DOUBLE / (10 + b.r), 0), 9) AS score FROM a FULL OUTER JOIN b USING (id) ORDER BY score DESC, id LIMIT 25""")
def rrf_weighted_page(spark, d):
    fused = search.fuse(*_lists(spark, d), k=10, weights=(2.0, 0.5))
    return search.fused_page(fused, 25).select("id", F.col("keyword_rank").cast("bigint").alias("keyword_rank"), F.col("semantic_rank").cast("bigint").alias("semantic_rank"), "score")


# --- search over sections and references, and the fused page --------------------------------------------

VISIBLE = "processing_status IN ('PROCESSED', 'VERIFIED')"


def _acts_to_search(spark, d):
    return T.acts(spark, d).withColumn("normalized_title", X.search_form(F.col("title")))


# FLT-07, FLT-12, MTH-10
@query(f"""WITH {ACTS}, {SECTIONS}, j AS (SELECT act_id || '/' || sort_order AS id, sort_order::VARCHAR AS num, heading, lower(heading) AS h, {FORM.format('text')} AS form, {FORM.format('title')} AS title_form, verification_status
  FROM sections JOIN acts ON act_id = acts.id WHERE {VISIBLE} AND verification_status IN ('VERIFIED', 'PENDING', 'NEEDS_REVIEW'))
SELECT 'SECTION' AS result_type, id, round(0.25::DOUBLE + CASE WHEN num = 'er' THEN 5.5::DOUBLE ELSE 0 END + CASE WHEN h = 'er' THEN 5.0::DOUBLE WHEN contains(h, 'er') THEN 3.6::DOUBLE ELSE 0 END + CASE WHEN contains(form, 'er') THEN 1.6::DOUBLE ELSE 0 END
  + CASE WHEN contains(title_form, 'er') THEN 1.2::DOUBLE ELSE 0 END + CASE verification_status WHEN 'VERIFIED' THEN 0.4::DOUBLE ELSE 0 END, 6) AS score
FROM j WHERE num = 'er' OR contains(h, 'er') OR contains(title_form, 'er') OR contains(form, 'er')""")
def search_sections(spark, d):
    number = F.col("sort_order").cast("string")
    s = T.sections(spark, d).withColumns({"id": F.concat_ws("/", "act_id", "sort_order"), "section_number": number, "section_path": number, "normalized_text": X.search_form(F.col("text"))})
    return search.section_hits(s, _acts_to_search(spark, d), "er", "LAWYER", verification="verified_pending").select("result_type", "id", "score")


SEARCHED_REFS = """cited AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_suppkey AS source_act_id, CASE WHEN l_returnflag = 'A' THEN 'amends' ELSE 'see' END || ' section ' || l_linenumber AS raw, 'Levy ' || (l_partkey % 9) || ' Act' AS named,
  CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'N' THEN 'REFERS_TO' ELSE 'REPEALS' END AS kind, CASE l_linestatus WHEN 'F' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN l_linenumber <> 6 THEN l_discount END AS confidence, l_linenumber % 3 <> 0 AS mapped FROM lineitem)"""


def _references_to_search(spark, d):
    flag, none = F.col("l_returnflag"), F.lit(None).cast("string")
    return T.read(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_suppkey").alias("source_act_id"), F.concat(F.when(flag == "A", "amends").otherwise("see"), F.lit(" section "), "l_linenumber").alias("raw_reference_text"), F.lit("").alias("context_snippet"),
        F.concat(F.lit("Levy "), F.col("l_partkey") % 9, F.lit(" Act")).alias("target_act_title_raw"), none.alias("target_act_number"), F.lit(None).cast("int").alias("target_act_year"), none.alias("target_section_number"), none.alias("target_section_path"),
        F.when(flag == "A", "AMENDS").when(flag == "N", "REFERS_TO").otherwise("REPEALS").alias("relationship_type"), F.when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("NEEDS_REVIEW").alias("verification_status"),
        F.when(F.col("l_linenumber") != 6, F.col("l_discount")).cast("double").alias("confidence_score"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey").cast("string")).alias("target_act_id"), none.alias("target_section_id"),
    )


# FLT-08, FLT-03, MTH-10: the word names a relationship, a text has it too
@query(f"""WITH {ACTS}, {SEARCHED_REFS} SELECT c.id, round(0.2::DOUBLE + coalesce(confidence, 0) + CASE WHEN contains(raw, 'amends') THEN 2.4::DOUBLE ELSE 0 END + CASE kind WHEN 'AMENDS' THEN 3.2::DOUBLE ELSE 0 END + 0.4::DOUBLE + 0.2::DOUBLE, 6) AS score
FROM cited c JOIN acts a ON a.id = source_act_id WHERE {VISIBLE} AND status = 'VERIFIED' AND mapped AND (contains(raw, 'amends') OR kind = 'AMENDS')""")
def search_references(spark, d):
    return search.reference_hits(_references_to_search(spark, d), _acts_to_search(spark, d), "amends", "GENERAL_USER").select("id", "score")


# FLT-08, FLT-10, FLT-11 with every filter: type, status, unresolved
@query(f"""WITH {ACTS}, {SEARCHED_REFS} SELECT c.id, round(0.2::DOUBLE + coalesce(confidence, 0) + 2.5::DOUBLE + CASE WHEN contains(lower(named), 'levy 4') THEN 1.8::DOUBLE ELSE 0 END, 6) AS score
FROM cited c JOIN acts a ON a.id = source_act_id WHERE {VISIBLE} AND status = 'NEEDS_REVIEW' AND NOT mapped AND kind = 'REPEALS' AND contains(lower(named), 'levy 4')""")
def search_references_filtered(spark, d):
    return search.reference_hits(_references_to_search(spark, d), _acts_to_search(spark, d), "Levy 4", "LAWYER", relationship="REPEALS", verification="NEEDS_REVIEW", mapped="unresolved").select("id", "score")


# FLT-09: acts and sections that a query names exactly
@query(f"WITH {ACTS}, {SECTIONS} SELECT act_id, sort_order FROM sections JOIN acts ON acts.id = act_id WHERE act_number = '9' AND year = 1987 AND sort_order = 3 OR act_number = '9' AND year = 1987 AND sort_order = 1")
def search_exact_identifiers(spark, d):
    number = F.col("sort_order").cast("string")
    rows = T.sections(spark, d).withColumns({"section_number": number, "section_path": number}).join(_acts_to_search(spark, d).withColumnRenamed("id", "act_id"), "act_id")
    wanted = (Q.exact_section(Q.parse(q)) for q in ("section 3 of Act No. 9 of 1987", "Act No. 9 of 1987, s. 1"))
    return rows.where(search._any(*wanted)).select("act_id", "sort_order")


# HYB-01, HYB-02, HYB-03, PRJ-06, FLT-15, SRT-05: the fused page of a query that names a section
@query(f"""WITH {ACTS}, {VECTORS}, q AS (SELECT embedding AS e FROM vecs ORDER BY section_id LIMIT 1),
s AS (SELECT v.section_id::VARCHAR AS id, v.act_id AS label, title, 1 - list_cosine_similarity(embedding, e) AS raw_distance FROM vecs v JOIN acts a ON a.id = v.section_id % 150 JOIN q ON true WHERE {VISIBLE} AND v.section_id % 4 <> 0),
kw AS (SELECT id, row_number() OVER (ORDER BY title, id) AS r FROM s WHERE label = 3 QUALIFY r <= 100),
sem AS (SELECT id, label = 3 AS tier, row_number() OVER (ORDER BY label = 3 DESC, round(raw_distance, 9), id) AS r FROM s QUALIFY r <= 100)
SELECT 'hybrid' AS mode, 'SECTION' AS result_type, id, round(coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + sem.r), 0) + CASE WHEN kw.r IS NOT NULL OR tier THEN 200.0::DOUBLE ELSE 0 END, 9) AS score
FROM kw FULL JOIN sem USING (id) ORDER BY score DESC, id LIMIT 20 OFFSET 3""")
def search_hybrid_page(spark, d):
    v = T.vectors(spark, d)
    label = F.col("act_id").cast("string")
    sections = v.select(
        F.col("section_id").cast("string").alias("id"), (F.col("section_id") % 150).alias("act_id"), label.alias("section_number"), label.alias("section_path"), F.concat(F.lit("section "), label).alias("heading"), F.concat(F.lit("text "), "section_id").alias("text"),
        F.concat(F.lit("text "), "section_id").alias("normalized_text"), F.when(F.col("section_id") % 4 != 0, "VERIFIED").otherwise("PENDING").alias("verification_status"), "embedding",
    )
    mode, page = hybrid.search_page(_acts_to_search(spark, d), sections, _references_to_search(spark, d).where("raw_reference_text NOT LIKE '%section 3%'"), "section 3", vector=_probe(spark, d), limit=20, offset=3)
    return page.select(F.lit(mode).alias("mode"), "result_type", "id", "score")


# --- joins -----------------------------------------------------------------------------------


# JOI-01, JOI-02
@query(f"WITH {ACTS}, {SECTIONS} SELECT act_id, sort_order, a.category FROM sections s JOIN acts a ON s.act_id = a.id")
def join_inner_act(spark, d):
    return rows.with_parent(T.sections(spark, d), T.acts(spark, d), "act_id", category="category").select("act_id", "sort_order", "category")


# JOI-04, PRJ-02
@query(f"""WITH {ACTS}, {REFS} SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.source, a.title AS source_title, b.title AS target_title FROM refs r LEFT JOIN acts a ON r.source = a.id LEFT JOIN acts b ON r.target = b.id""")
def join_left_targets(spark, d):
    acts = T.acts(spark, d)
    out = rows.with_parent(rows.with_parent(T.references(spark, d), acts, "target", "left", few=True, target_title="title"), acts, "source", "left", few=True, source_title="title")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "source", "source_title", "target_title")


# JOI-06: a semi-join
@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_semi_saved(spark, d):
    return rows.having(T.read(spark, d, "part"), T.read(spark, d, "lineitem").where("l_quantity > 49"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


# JOI-17
@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti_unmapped(spark, d):
    dear = T.read(spark, d, "orders").where("o_totalprice > 300000")
    return rows.having(T.read(spark, d, "customer"), dear, "c_custkey", "o_custkey", without=True).select("c_custkey")


# JOI-09: by number and year; of several acts the least id
@query(f"""WITH {ACTS}, wanted AS (SELECT o_orderkey, (o_custkey % 60)::VARCHAR AS number, (1978 + o_orderkey % 60)::INTEGER AS y FROM orders)
SELECT o_orderkey, min(a.id) AS act FROM wanted LEFT JOIN acts a ON a.act_number = number AND a.year = y GROUP BY 1""")
def join_two_key(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60).cast("string").alias("act_number"), (1978 + F.col("o_orderkey") % 60).cast("int").alias("year"))
    return o.join(mapping.acts_by_number(T.acts(spark, d)), ["act_number", "year"], "left").select("o_orderkey", F.col("by_number").alias("act"))


# JOI-10: candidates in order, the first match
@query(f"""WITH {ACTS}, cand AS (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest(['src' || (o_custkey % 40), 'src' || (o_orderkey % 30), 'src1']) AS wanted FROM orders),
titled AS (SELECT category, min(id) AS act FROM acts GROUP BY 1)
SELECT o_orderkey, arg_min(act, pos) AS act FROM cand JOIN titled ON wanted = category GROUP BY 1""")
def join_title_candidates(spark, d):
    o = T.read(spark, d, "orders")
    forms = F.array(F.concat(F.lit("src"), F.col("o_custkey") % 40), F.concat(F.lit("src"), F.col("o_orderkey") % 30), F.lit("src1"))
    titled = T.acts(spark, d).groupBy("category").agg(F.min("id").alias("act"))
    return rows.first_match(o.select("o_orderkey", forms.alias("forms")), "o_orderkey", "forms", titled, "category", "act")


# JOI-11: containment of a word list, as an equi-join on words
@query("""WITH nouns AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) SELECT p_partkey, w FROM part, nouns WHERE list_contains(string_split(p_name, ' '), w)""")
def join_contains_words(spark, d):
    p = T.read(spark, d, "part")
    words = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    return words.join(p.select(F.element_at(F.split("p_name", " "), 1).alias("w")).distinct(), "w").select("p_partkey", "w")


# JOI-14, WIN-07: interval overlap of lines with pages of 500 characters
@query(f"""WITH {ACTS}, lines AS (SELECT id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS k FROM acts),
placed AS (SELECT id, k, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, length(line) AS n FROM lines)
SELECT id, k::BIGINT AS k, a AS source_start, a // 500 + 1 AS page_start, (a + greatest(n, 1) - 1) // 500 + 1 AS page_end FROM placed""")
def join_interval_overlap(spark, d):
    lines = T.acts(spark, d).select("id", F.posexplode(F.split("raw_text", "\n")).alias("k", "line"))
    before = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint")
    s = lines.select("id", (F.col("k") + 1).cast("bigint").alias("k"), start.alias("source_start"), F.length("line").alias("n")).withColumn("source_end", F.col("source_start") + F.greatest(F.col("n"), F.lit(1)))
    pages = T.acts(spark, d).select("id", F.explode(F.sequence(F.lit(0), F.floor(F.length("raw_text") / 500).cast("int"))).alias("p"))
    spans = pages.select("id", (F.col("p") + 1).cast("bigint").alias("page_number"), (F.col("p") * 500).cast("bigint").alias("start"), (F.col("p") * 500 + 500).cast("bigint").alias("end"))
    return documents.section_pages(s, spans).select("id", "k", "source_start", "page_start", "page_end")


# JOI-05, JOI-06
@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")
def join_exists_or(spark, d):
    cheap = T.read(spark, d, "lineitem").where("l_discount > 0.09")
    return rows.having_or(T.read(spark, d, "orders"), cheap, "o_orderkey", "l_orderkey", F.col("o_totalprice") > 400000).select("o_orderkey")


# JOI-07, SRT-08
@query(f"WITH {ACTS}, {SECTIONS} SELECT act_id, sort_order, title FROM sections s JOIN acts a ON a.id = s.act_id WHERE verification_status = 'REJECTED' ORDER BY act_id DESC, sort_order DESC LIMIT 10")
def join_failed_samples(spark, d):
    failed = rows.with_parent(T.sections(spark, d).where("verification_status = 'REJECTED'"), T.acts(spark, d), "act_id", title="title")
    return failed.orderBy(F.col("act_id").desc(), F.col("sort_order").desc()).limit(10).select("act_id", "sort_order", "title")


# JOI-08: gold identities (file name and path) that name exactly one section
@query("""WITH one AS (SELECT p_name, p_size, min(p_partkey) AS section_id FROM part GROUP BY 1, 2 HAVING count(*) = 1), gold AS (SELECT DISTINCT p_partkey % 50 AS query_id, p_name, p_size FROM part)
SELECT query_id, p_name || '.pdf' AS document_identifier, p_size::VARCHAR AS expected_section_path, section_id FROM gold JOIN one USING (p_name, p_size)""")
def join_unique_identity(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("query_id"), F.concat("p_name", F.lit(".pdf")).alias("source_file_name"), F.col("p_size").cast("string").alias("section_path"))
    gold = p.select("query_id", F.col("source_file_name").alias("document_identifier"), F.col("section_path").alias("expected_section_path")).distinct()
    found, _ = evaluation.resolve_gold(gold, p.select("id", F.col("id").alias("act_id"), "section_path"), p.select("id", "source_file_name"))
    return found.select("query_id", "document_identifier", "expected_section_path", "section_id")


# JOI-08: keys that one row has
@query("SELECT p_name, p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1")
def join_unique_keys(spark, d):
    return rows.unique_keys(T.read(spark, d, "part"), ["p_name", "p_brand", "p_size"], "p_partkey")


CONTEXT = f"""WITH {REFS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, l_orderkey, l_linenumber, l_partkey) AS pos FROM refs),
f AS (SELECT *, relationship <> 'REFERS_TO' AND target IS NULL AND l_linenumber % 2 = 0 AS bare, l_linenumber = 5 AS principal,
  CASE WHEN target IS NOT NULL AND l_linenumber <> 5 THEN target END AS own FROM r),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM f)"""


# JOI-16, WIN-05
@query(CONTEXT + " SELECT source, pos, context, CASE WHEN (bare OR principal) AND context IS NOT NULL THEN context ELSE own END AS resolved FROM c")
def asof_principal_context(spark, d):
    order = Window.partitionBy("source").orderBy("created_at", "l_orderkey", "l_linenumber", "l_partkey")
    principal = F.col("l_linenumber") == 5
    r = T.references(spark, d).withColumns({
        "pos": F.row_number().over(order).cast("bigint"), "principal": principal, "own": F.when(~principal, F.col("target")),
        "bare": (F.col("relationship") != "REFERS_TO") & F.col("target").isNull() & (F.col("l_linenumber") % 2 == 0),
    })
    return mapping.resolve_context(r, "source", "pos").select("source", "pos", "context", "resolved")


# WIN-06; levenshtein stands in for the fuzzy ratio, which SQL lacks
@query("""WITH p AS (SELECT p_brand, p_partkey, p_name, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS s FROM part),
r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY s DESC, p_partkey))
SELECT p_brand, p_partkey, s, s >= 0.1 AND (nxt IS NULL OR s - nxt >= 0.01) AS sure FROM r WHERE k = 1""")
def fuzzy_margin_topcandidate(spark, d):
    sixth = {k: tuple(lambda a, b, f=f: F.round(f(a, b), 6) for f in v) if k == "bounds" else lambda a, b, f=v: F.round(f(a, b), 6) for k, v in fuzzy.EDITS.items()}
    best = fuzzy.best_match(T.read(spark, d, "part"), ["p_brand"], "p_name", "p_type", "p_partkey", least=0.0, margin=0.01, **sixth)
    return best.select("p_brand", "p_partkey", F.col("score").alias("s"), (F.col("sure") & (F.col("score") >= 0.1)).alias("sure"))


TITLES = f"titles AS (SELECT title, min(id) AS act, count(*) AS holders FROM (SELECT id, {FORM.format('title')} AS title FROM acts) WHERE title <> '' GROUP BY 1), wanted AS (SELECT DISTINCT trim(substr(title, 5, 24)) AS wanted FROM titles WHERE length(title) > 4)"


# JOI-10, JOI-11, WIN-06, STR-24: parts of titles, each resolved once; held in a title, the ratio is twice the shorter length over both
@query(f"""WITH {ACTS}, {TITLES}, exact AS (SELECT wanted, act FROM wanted JOIN titles ON wanted = title),
near AS (SELECT wanted, act, holders, 2.0::DOUBLE * length(wanted) / (length(wanted) + length(title)) AS r FROM wanted JOIN titles ON contains(title, wanted) WHERE length(wanted) >= 4 AND wanted NOT IN (SELECT wanted FROM exact)),
best AS (SELECT *, row_number() OVER w AS k, lead(r) OVER w AS nxt FROM near WINDOW w AS (PARTITION BY wanted ORDER BY r DESC, act))
SELECT wanted, act, 'exact' AS kind FROM exact UNION ALL SELECT wanted, CASE WHEN holders = 1 AND (nxt IS NULL OR r - nxt >= 0.15) THEN act END, 'partial' FROM best WHERE k = 1 AND r >= 0.5""")
def map_titles(spark, d):
    acts = T.acts(spark, d).select("id", X.search_form(F.col("title")).alias("normalized_title"))
    wanted = acts.where(F.length("normalized_title") > 4).select(F.trim(F.substring("normalized_title", 5, 24)).alias("wanted")).distinct()
    return mapping.resolve_titles(wanted, acts)


# JOI-12
@query("""WITH a AS (SELECT p_partkey AS id, 'Vol. ' || p_partkey || ', Chapter ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END || ' rev.' AS source_name, 'http://acts/chapter ' || (p_size * 7) AS source_url FROM part),
w AS (SELECT c_custkey, 'chapter ' || (c_custkey % 400) || CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE '' END AS place FROM customer)
SELECT c_custkey, min(id) AS act FROM w LEFT JOIN a ON contains(lower(source_name), place) OR contains(lower(source_url), place) GROUP BY 1""")
def map_chapters(spark, d):
    suffix = F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("")
    acts = T.read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit("t").alias("normalized_title"), F.concat(F.lit("Vol. "), "p_partkey", F.lit(", Chapter "), "p_size", suffix, F.lit(" rev.")).alias("source_name"),
        F.concat(F.lit("http://acts/chapter "), F.col("p_size") * 7).alias("source_url"), F.lit(None).cast("string").alias("act_number"), F.lit(None).cast("int").alias("year"),
    )
    none = F.lit(None).cast("string")
    cited = F.concat(F.lit("Chapter "), F.col("c_custkey") % 400, F.when(F.col("c_custkey") % 3 == 0, "a").otherwise(""))
    refs = T.read(spark, d, "customer").select("c_custkey", cited.alias("target_act_title_raw"), none.alias("raw_reference_text"), none.alias("target_section_path"), none.alias("target_act_number"), F.lit(None).cast("int").alias("target_act_year"))
    return mapping.own_target(refs, acts).select("c_custkey", F.col("own").alias("act"))


# --- aggregations ------------------------------------------------------------------------------


# AGG-05
@query(f"""WITH {ACTS}, {SECTIONS}, {REFS}, s AS (SELECT act_id, count(*) AS n, count(*) FILTER (verification_status = 'VERIFIED') AS v, count(*) FILTER (verification_status = 'PENDING') AS p FROM sections GROUP BY 1),
r AS (SELECT source, count(*) AS n, count(*) FILTER (verification_status = 'NEEDS_REVIEW') AS w, count(target) AS m FROM refs GROUP BY 1)
SELECT id AS act_id, coalesce(s.n, 0) AS sections, coalesce(s.v, 0) AS sections_verified, coalesce(s.p, 0) AS sections_pending, coalesce(r.n, 0) AS "references", coalesce(r.w, 0) AS references_needs_review, coalesce(r.m, 0) AS mapped, coalesce(r.n - r.m, 0) AS unresolved
FROM acts LEFT JOIN s ON s.act_id = id LEFT JOIN r ON r.source = id""")
def agg_verification_summary(spark, d):
    r = T.references(spark, d).select(F.col("source").alias("source_act_id"), F.col("target").alias("target_act_id"), F.lit(None).cast("bigint").alias("target_section_id"), "verification_status")
    out = catalog.verification_summary(T.acts(spark, d), T.sections(spark, d), r)
    return out.select("act_id", "sections", "sections_verified", "sections_pending", "references", "references_needs_review", "mapped", "unresolved")


# AGG-06, AGG-25
@query(f"""WITH {ACTS}, {SECTIONS}, {REFS}, s AS (SELECT act_id, count(*) AS n FROM sections WHERE verification_status = 'VERIFIED' GROUP BY 1), r AS (SELECT source, count(*) AS n FROM refs WHERE verification_status = 'VERIFIED' GROUP BY 1)
SELECT id, title, processing_status, coalesce(s.n, 0) AS verified_sections, coalesce(r.n, 0) AS verified_references FROM acts LEFT JOIN s ON s.act_id = id LEFT JOIN r ON r.source = id""")
def agg_browse_counts(spark, d):
    return catalog.browse_counts(T.acts(spark, d), T.sections(spark, d), T.references(spark, d))


# AGG-07, JOI-18, SRT-10
@query(f"""WITH {ACTS}, {REFS}, r AS (SELECT source, count(*) FILTER (verification_status = 'NEEDS_REVIEW') AS n, count(*) - count(target) AS u FROM refs GROUP BY 1)
SELECT id, title, n AS needs_review, u AS unresolved FROM acts JOIN r ON source = id WHERE n > 0""")
def agg_review_queue(spark, d):
    return catalog.review_queue(T.acts(spark, d), T.references(spark, d))


# AGG-08
@query(f"WITH {REFS}, domain(value) AS (VALUES " + ", ".join(f"('{v}')" for v in schemas.RELATIONSHIPS) + ") SELECT value, coalesce(n, 0) AS n FROM domain LEFT JOIN (SELECT relationship AS value, count(*) AS n FROM refs GROUP BY 1) USING (value)")
def agg_corpus_metrics(spark, d):
    return catalog.domain_counts(T.references(spark, d), "relationship", schemas.RELATIONSHIPS)


# AGG-09
@query(f"""WITH {REFS}, own AS (SELECT * FROM refs WHERE source = 7 OR target = 7)
SELECT count(*) AS total, count(*) FILTER (source = 7) AS outgoing, count(*) FILTER (source <> 7) AS incoming, count(target) AS mapped, count(*) - count(target) AS unresolved FROM own""")
def agg_relationship_summary(spark, d):
    return graph.summary(T.references(spark, d), 7).drop("by_type", "by_status")


# AGG-10
@query(f"WITH {REFS} SELECT relationship, count(*) AS n, count(*) - count(target) AS unresolved, count(*) FILTER (confidence >= 0.5) AS confident FROM refs GROUP BY 1")
def agg_reference_summary(spark, d):
    return catalog.reference_summary(T.references(spark, d))


# AGG-02, AGG-03, AGG-14
@query(f"WITH {SECTIONS} SELECT act_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (verification_status = '{v}') AS {v.lower()}" for v in schemas.VERIFICATION) + " FROM sections GROUP BY 1")
def agg_status_counts(spark, d):
    return catalog.tallies(T.sections(spark, d), "act_id", "verification_status", schemas.VERIFICATION)


# AGG-13
@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_saved_by_type(spark, d):
    return rows.counts_by(T.history(spark, d).withColumnRenamed("item_type", "event_type"), "event_type")


# AGG-04
@query("SELECT max(ts) AS last_at, count(*) AS n FROM events")
def agg_latest_embedding(spark, d):
    return rows.latest_at(T.history(spark, d), "viewed_at")


# AGG-26
@query("""WITH t AS (SELECT 'raw' AS parser, page_id AS id, html AS text FROM pages UNION ALL SELECT 'text', page_id, regexp_replace(html, '<[^>]*>', '', 'g') FROM pages), g AS (SELECT page_id AS id, unnest(['<p>', 'the', 'article']) AS span FROM pages)
SELECT parser, id, max(length(text))::INTEGER AS chars, sum(contains(text, span)::INT)::BIGINT AS found, round(avg(contains(text, span)::INT), 4) AS recall FROM t JOIN g USING (id) GROUP BY 1, 2""")
def agg_parser_comparison(spark, d):
    p = T.read(spark, d, "pages").select(F.col("page_id").alias("id"), "html")
    texts = p.select(F.lit("raw").alias("parser"), "id", F.col("html").alias("text")).unionAll(p.select(F.lit("text"), "id", F.regexp_replace("html", "<[^>]*>", "")))
    return evaluation.parser_comparison(texts, p.select("id", F.explode(F.array(*map(F.lit, ("<p>", "the", "article")))).alias("span")))


# --- graph -------------------------------------------------------------------------------------


def _edges(spark, d):
    return graph.edges(T.references(spark, d))


# AGG-19, DOC-14
@query(f"WITH {EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


# AGG-20, AGG-21
@query(f"""WITH {EDGES}, b AS (SELECT source AS act, target AS other, n FROM edges UNION ALL SELECT target, source, n FROM edges)
SELECT act, count(DISTINCT other) AS neighbours, sum(n)::BIGINT AS citations FROM b GROUP BY 1""")
def graph_neighbors(spark, d):
    return graph.neighbours(_edges(spark, d))


# WIN-08
@query(f"""WITH {EDGES} SELECT source, target, label, n, pending, row_number() OVER w - 1 - (count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) - 1) / 2.0::DOUBLE AS "offset"
FROM edges WINDOW w AS (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, target, label)""")
def graph_pair_offsets(spark, d):
    return graph.pair_offsets(_edges(spark, d))


# AGG-22, SRT-11
@query(f"""WITH {EDGES}, near AS (SELECT CASE WHEN source = 3 THEN target ELSE source END AS counterpart, label, n, pending FROM edges WHERE source = 3 OR target = 3)
SELECT counterpart, sum(n)::BIGINT AS total, bool_or(pending) AS pending FROM near GROUP BY 1""")
def graph_linked_acts(spark, d):
    return graph.linked_acts(_edges(spark, d), 3).drop("by_type")


# AGG-23, AGG-24, PRJ-02
@query(f"""WITH {REFS}, rows AS (SELECT 3 AS focus, source, target, relationship, verification_status, source <> 3 AS incoming FROM refs WHERE source = 3 OR target = 3),
fam AS (SELECT *, CASE WHEN incoming THEN 'incoming' WHEN target = 3 OR target = source THEN 'internal' WHEN target IS NULL THEN 'unresolved' WHEN relationship IN ('AMENDS', 'REPEALS') THEN 'amends' ELSE 'refers' END AS family FROM rows)
SELECT family, CASE family WHEN 'incoming' THEN source WHEN 'unresolved' THEN NULL ELSE target END AS counterpart, count(*) AS n, bool_or(verification_status <> 'VERIFIED') AS pending, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS types FROM fam GROUP BY 1, 2""")
def graph_dossier(spark, d):
    none = F.lit(None).cast("string")
    r = T.references(spark, d).where("source = 3 OR target = 3").select(
        F.lit(3).cast("bigint").alias("focus"), F.col("source").alias("source_act_id"), F.col("target").alias("target_act_id"), F.col("relationship").alias("relationship_type"), "verification_status",
        F.when(F.col("source") == 3, "outgoing").otherwise("incoming").alias("direction"), none.alias("target_act_title_raw"), none.alias("raw_reference_text"), none.alias("target_act_number"), F.lit(None).cast("int").alias("target_act_year"),
    )
    return graph.dossier(r).drop("focus", "label")


# SRT-16
@query(f"""WITH {EDGES}, g AS (SELECT target AS counterpart, CASE WHEN label = 'REFERS_TO' THEN 'refers' ELSE 'amends' END AS family, sum(n)::BIGINT AS n FROM edges GROUP BY 1, 2)
SELECT counterpart, family, n FROM g QUALIFY row_number() OVER (PARTITION BY counterpart ORDER BY n DESC, family DESC) = 1""")
def graph_busiest_group(spark, d):
    g = _edges(spark, d).groupBy(F.col("target").alias("counterpart"), graph.family_of_type(F.col("label")).alias("family")).agg(F.sum("n").alias("n"))
    return graph.busiest_group(g)


# SET-06
@query(f"WITH {ACTS}, {EDGES} SELECT i.id, title FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) i LEFT JOIN acts a ON a.id = i.id")
def graph_nodes(spark, d):
    return graph.nodes(_edges(spark, d), T.acts(spark, d))


# SRT-14, DOC-15
@query(f"WITH {EDGES}, s AS (SELECT * FROM edges WHERE source = 3 OR target = 3) SELECT id FROM (SELECT source AS id FROM s UNION SELECT target FROM s UNION SELECT 3) ORDER BY id <> 3, id LIMIT 8")
def graph_visible_nodes(spark, d):
    return graph.visible_nodes(graph.selected(_edges(spark, d), 3), 3).select(F.col("id").cast("bigint").alias("id"))


# MTH-11, STR-28, DOC-16
@query(f"""WITH {EDGES} SELECT source, target, label, round(least(8, 1.75::DOUBLE + 1.35::DOUBLE * log2(n)), 6) AS width, upper(label[1]) || replace(lower(label[2:]), '_', ' ') || ' · ' || n AS shown,
CASE WHEN target = 3 AND source <> 3 THEN 'incoming|' || source ELSE CASE WHEN label = 'REFERS_TO' THEN 'refers|' ELSE 'amends|' END || target END AS key FROM edges""")
def graph_edge_style(spark, d):
    e = _edges(spark, d)
    return e.select("source", "target", "label", F.round(M.stroke_width(F.col("n")), 6).alias("width"), F.concat_ws(" · ", X.type_label(F.col("label")), F.col("n")).alias("shown"), graph.dossier_key(3).alias("key"))


# --- windows -----------------------------------------------------------------------------------


# WIN-02
@query(f"WITH {SECTIONS} SELECT act_id, sort_order, lead(sort_order, 1, 9999) OVER (PARTITION BY act_id ORDER BY sort_order) AS until FROM sections")
def win_next_boundary(spark, d):
    return rows.next_start(T.sections(spark, d), "act_id", "sort_order", F.lit(9999)).select("act_id", "sort_order", "until")


# WIN-03
@query(f"WITH {SECTIONS} SELECT act_id, sort_order, heading FROM sections QUALIFY heading IS DISTINCT FROM lag(heading) OVER (PARTITION BY act_id ORDER BY sort_order)")
def win_drop_repeated(spark, d):
    return rows.without_repeats(T.sections(spark, d), "act_id", "sort_order", "heading").select("act_id", "sort_order", "heading")


# WIN-09
@query(f'WITH {SECTIONS} SELECT act_id, sort_order, lag(sort_order) OVER w AS previous, lead(sort_order) OVER w AS "next" FROM sections WINDOW w AS (PARTITION BY act_id ORDER BY sort_order)')
def win_adjacent_sections(spark, d):
    return catalog.adjacent(T.sections(spark, d)).select("act_id", "sort_order", "previous", "next")


# WIN-07
@query(f"WITH {SECTIONS} SELECT act_id, sort_order, coalesce(sum(length(text) + 2) OVER (PARTITION BY act_id ORDER BY sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sections")
def win_running_offsets(spark, d):
    s = T.sections(spark, d).select(F.col("act_id").alias("id"), F.col("sort_order").alias("page_number"), "text")
    return documents.page_spans(s).select(F.col("id").alias("act_id"), F.col("page_number").alias("sort_order"), F.col("start").cast("bigint").alias("start"))


# WIN-04, SRT-09
@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS sort_order FROM lineitem")
def win_sort_order(spark, d):
    lines = rows.numbered(T.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "sort_order")


# WIN-10: the last line with text among the four before
@query(f"""WITH {ACTS}, lines AS (SELECT id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS k FROM acts)
SELECT id, k::BIGINT AS k, last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS above FROM lines""")
def win_marginal_heading(spark, d):
    lines = T.acts(spark, d).select("id", F.posexplode(F.split("raw_text", "\n")).alias("k", "line"))
    return rows.text_above(lines, "id", "k", "line").select("id", (F.col("k") + 1).cast("bigint").alias("k"), "above")


# WIN-12
@query(f"WITH {SECTIONS} SELECT act_id, sort_order FROM sections QUALIFY row_number() OVER (PARTITION BY act_id ORDER BY sort_order) <= 3")
def win_first_n_per_group(spark, d):
    return state.first_per_group(T.sections(spark, d), "act_id", "sort_order", 3).select("act_id", "sort_order")


# WIN-11, ARR-01
@query("""SELECT conv_id, string_agg(role, ',' ORDER BY first) AS kept FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def win_keep_first_duplicate(spark, d):
    return rows.distinct_in_order(T.read(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("kept", ",").alias("kept"))


# --- evaluation ----------------------------------------------------------------------------------


def _gold(spark, d):
    docs, labels = T.read(spark, d, "documents"), T.read(spark, d, "labels")
    return labels.where("quality = 1").select("doc_id"), docs.where("n_chars > 1500").select("doc_id")


# AGG-15, SET-03
@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM documents WHERE n_chars > 1500),
c AS (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL OUTER JOIN p USING (doc_id))
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS "precision", round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""")
def eval_set_metrics(spark, d):
    return evaluation.set_metrics(*_gold(spark, d), keys=["doc_id"])


# AGG-16
@query("SELECT round(count(p.doc_id)::DOUBLE / count(*), 4) AS accuracy FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 1500) p USING (doc_id)")
def eval_segmentation_accuracy(spark, d):
    return evaluation.segmentation_accuracy(*_gold(spark, d), key="doc_id")


# SET-04, SET-05
@query("""SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1500 ORDER BY doc_id LIMIT 100)
UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 1500 EXCEPT SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 100)""")
def eval_set_diff_top100(spark, d):
    missing, extra = evaluation.differences(*_gold(spark, d), key="doc_id")
    return missing.select(F.lit("missing").alias("kind"), "doc_id").unionAll(extra.select(F.lit("extra"), "doc_id"))


def _ranked(spark, d):
    """Queries are customers, results their orders by price, graded by priority."""
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderpriority")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("o_totalprice").desc(), "item"))
    grade = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0)
    queries_ = T.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return o.select("query_id", "item", rank.alias("rank")), o.select("query_id", "item", grade.alias("grade")), queries_


RANKED = """WITH o AS (SELECT o_custkey AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS grade FROM orders),
i AS (SELECT q, count(*) AS rel, sum(CASE WHEN k <= 10 THEN (2.0::DOUBLE ** grade - 1) / log2(k + 1) END) AS idcg FROM (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC, item) AS k FROM o WHERE grade > 0) GROUP BY 1),
s AS (SELECT q, count(*) AS n, count(*) FILTER (grade > 0 AND rank <= 5) AS h5, count(*) FILTER (grade > 0 AND rank <= 10) AS h10, min(rank) FILTER (grade > 0) AS first, sum(CASE WHEN rank <= 10 THEN (2.0::DOUBLE ** grade - 1) / log2(rank + 1) END) AS dcg FROM o GROUP BY 1),
m AS (SELECT c_custkey AS query_id, round(coalesce(h5, 0) / 5.0::DOUBLE, 6) AS p5, round(CASE WHEN rel > 0 THEN coalesce(h5, 0)::DOUBLE / rel ELSE 1 END, 6) AS r5, round(CASE WHEN rel > 0 THEN coalesce(h10, 0)::DOUBLE / rel ELSE 1 END, 6) AS r10,
  round(CASE WHEN rel > 0 THEN coalesce(1.0::DOUBLE / first, 0) ELSE 0 END, 6) AS mrr, round(CASE WHEN rel > 0 THEN coalesce(dcg / idcg, 0) WHEN n IS NULL THEN 1 ELSE 0 END, 6) AS ndcg10, n IS NULL AS zero_result, coalesce(n, 0) AS retrieved
  FROM customer LEFT JOIN s ON s.q = c_custkey LEFT JOIN i ON i.q = c_custkey)"""


# AGG-17, MAP-01
@query(RANKED + " SELECT * FROM m")
def eval_ranking_metrics(spark, d):
    return evaluation.ranking_metrics(*_ranked(spark, d))


# AGG-18
@query(RANKED + """ SELECT count(*) AS queries, round(avg(p5), 6) AS p5, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(mrr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10, round(avg(zero_result::INT), 6) AS zero_rate,
round(sum(retrieved // 2)::DOUBLE / sum(retrieved), 6) AS verified_rate, median((query_id * 37 % 1009)::DOUBLE) AS median_ms, quantile_disc((query_id * 37 % 1009)::DOUBLE, 0.95) AS p95_ms FROM m""")
def eval_aggregate_p95(spark, d):
    m = evaluation.ranking_metrics(*_ranked(spark, d))
    return evaluation.aggregate_metrics(m.withColumns({"verified": F.floor(F.col("retrieved") / 2), "latency_ms": (F.col("query_id") * 37 % 1009).cast("double")}))


# --- text ------------------------------------------------------------------------------------------


# STR-01
@query(f"SELECT doc_id, {FORM.format('text')} AS form FROM documents")
def str_normalize(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.search_form(F.col("text")).alias("form"))


# STR-03, STR-23
@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM documents")
def str_squeeze_key(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.evaluation_key(F.col("text")).alias("key"))


# STR-05, STR-13
@query("SELECT p_partkey, upper(nullif(regexp_extract(p_brand, '(\\d+[A-Za-z]?)', 1), '')) AS number, try_cast(nullif(regexp_extract(p_partkey::VARCHAR, '(\\d{4})', 1), '') AS INTEGER) AS year FROM part")
def str_act_number(spark, d):
    return T.read(spark, d, "part").select("p_partkey", X.act_number(F.col("p_brand")).alias("number"), X.year(F.col("p_partkey").cast("string")).alias("year"))


# STR-06, STR-04
@query("""SELECT p_partkey, upper(regexp_extract(t, 'No\\. (\\d+) of', 1)) AS number, regexp_extract(t, 'of (\\d{4})', 1)::INTEGER AS year, p_name || ' Act' AS title, trim(regexp_replace(lower(p_name || ' Act'), '[^a-z0-9]+', ' ', 'g')) AS form
FROM (SELECT *, p_name || ' Act, No. ' || p_size || ' of ' || (1900 + p_size) AS t FROM part)""")
def str_citation_parse(spark, d):
    p = T.read(spark, d, "part")
    t = F.concat("p_name", F.lit(" Act, No. "), F.col("p_size"), F.lit(" of "), F.col("p_size") + 1900)
    c = X.citation(t)
    return p.select("p_partkey", c["number"].alias("number"), c["year"].alias("year"), F.concat(F.regexp_replace(c["title"], r",?\s*Act$", ""), F.lit(" Act")).alias("title"), X.act_title_form(t).alias("form"))


# STR-08..STR-11
@query("SELECT p_partkey, 'Chapter ' || p_size || 'A' AS chapter, p_size || 'B' AS section, 'First Schedule II' AS schedule, 'Part IV' AS part FROM part")
def str_reference_forms(spark, d):
    p, size = T.read(spark, d, "part"), F.col("p_size").cast("string")
    return p.select(
        "p_partkey", X.chapter(F.concat(F.lit("see chapter "), size, F.lit("a"))).alias("chapter"), X.section_number(F.concat(F.lit("section "), size, F.lit(" b"))).alias("section"),
        X.target_path(F.lit("the FIRST schedule II,")).alias("schedule_"), X.target_path(F.lit("part iv")).alias("part"),
    ).withColumn("schedule", F.replace("schedule_", F.lit("FIRST"), F.lit("First"))).drop("schedule_")


# STR-12, STR-16
@query(f"WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source, relationship AS named, CASE relationship WHEN 'AMENDS' THEN 'AMENDS' WHEN 'REPEALS' THEN 'REPEALS' ELSE 'REFERS_TO' END AS told FROM refs")
def str_relationship(spark, d):
    r, kind = T.references(spark, d), F.col("relationship")
    said = F.when(kind == "AMENDS", "It is hereby amended").when(kind == "REPEALS", "It is repealed.").otherwise("See section 4")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "source", X.relationship_word(F.replace(kind, F.lit("_"), F.lit("-"))).alias("named"), X.classify_relationship(said).alias("told"))


# STR-22, SNK-04, SNK-06
@query("SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT c_custkey, ['=', '+', '-', '@', '', 'x'][1 + c_custkey % 6] || c_name AS v FROM customer)")
def str_csv_safe(spark, d):
    v = F.concat(F.when(F.col("c_custkey") % 6 < 4, F.try_element_at(F.array(*map(F.lit, "=+-@")), (F.col("c_custkey") % 6 + 1).cast("int"))).when(F.col("c_custkey") % 6 == 4, "").otherwise("x"), F.col("c_name"))
    return exports.csv_rows(T.read(spark, d, "customer").withColumn("cell", v), ["c_custkey", "cell"]).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "cell")


# SNK-05
@query("SELECT '| ' || c_custkey || ' | ' || replace(c_name || '|' || c_mktsegment, '|', '\\|') || ' |' AS line FROM customer")
def sink_markdown_lines(spark, d):
    c = T.read(spark, d, "customer").withColumn("name", F.concat("c_name", F.lit("|"), "c_mktsegment"))
    return exports.markdown_lines(c, ["c_custkey", "name"])


# SNK-01, SNK-02
@query("""SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS sha256, true AS intact FROM conversations""")
def sink_artifact_digest(spark, d):
    a = exports.artifact(T.read(spark, d, "conversations"), ["turn", "role", "conv_id"])
    return exports.artifact_view(a, "conv_id long, role string, turn long").select("conv_id", "turn", "sha256", "intact")


# STR-25
@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def str_source_hash(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.source_hash(F.col("text")).alias("digest"))


# STR-26, STR-27
@query("SELECT p_partkey, concat_ws(chr(10), nullif(trim(p_name), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_brand END), ''), nullif(trim(p_type), '')) AS composed, array_to_string(string_split(p_type, ' ')[1:2], ' ') AS start FROM part")
def str_embedding_text(spark, d):
    brand = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand"))
    return T.read(spark, d, "part").select("p_partkey", X.embedding_text(F.col("p_name"), brand, F.col("p_type")).alias("composed"), X.first_tokens(F.col("p_type"), 2).alias("start"))


# STR-20
@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def str_html_to_text(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


# DAT-01
@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def date_loose_parse(spark, d):
    o = T.read(spark, d, "orders")
    day = F.day("o_orderdate")
    suffix = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    said = F.concat(day, suffix, F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", " MMMM yyyy")).otherwise(F.date_format("o_orderdate", " MMM yyyy")))
    return o.select("o_orderkey", X.loose_date(said).alias("day"))


# DAT-03
@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def date_iso_utc(spark, d):
    return T.read(spark, d, "events").select("event_id", exports.iso_utc(F.col("ts")).alias("at"))


# PRJ-05
@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Act No. ' || p_size || ' of 1999' WHEN 2 THEN 'Act of 1999' ELSE replace(p_brand, '#', ' ') END AS shown FROM part""")
def prj_display_title(spark, d):
    k = F.col("p_size") % 4
    title = F.when(k == 0, F.col("p_name")).otherwise(F.lit("untitled"))
    number, year = F.when(k == 1, F.col("p_size").cast("string")), F.when(k.isin(1, 2), 1999)
    return T.read(spark, d, "part").select("p_partkey", X.display_title(title, number, year, F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".PDF"))).alias("shown"))


# JSN-02
@query("SELECT event_id, coalesce((props::JSON ->> '$.k')::BIGINT, -1) AS k FROM events")
def json_field(spark, d):
    return T.read(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(F.parse_json("props"), "$.k", "bigint"), F.lit(-1)).alias("k"))


# MTH-07, MTH-08
@query(f"""WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source, CASE WHEN relationship <> 'REFERS_TO' THEN CASE WHEN target > 5 THEN 0.95 WHEN l_linenumber > 3 THEN 0.85 ELSE 0.7 END ELSE 0.3 END::DOUBLE AS extraction,
CASE WHEN target IS NULL THEN CASE WHEN l_linenumber > 3 THEN 0.55 ELSE 0.35 END WHEN l_linenumber > 3 THEN 0.98 ELSE 0.92 END::DOUBLE AS mapping FROM refs""")
def math_confidence(spark, d):
    r, section = T.references(spark, d), F.col("l_linenumber") > 3
    numbered = F.coalesce(F.col("target") > 5, F.lit(False))
    return r.select(
        "l_orderkey", "l_linenumber", "l_partkey", "source", M.extraction_confidence(F.col("relationship"), numbered, F.lit(True), section).alias("extraction"),
        M.mapping_confidence(F.when(F.col("target").isNotNull(), "exact"), section).alias("mapping"),
    )


# --- state -------------------------------------------------------------------------------------------


# STM-01, SRT-08
@query("SELECT user_id, event_type AS item_type, max(ts) AS viewed_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def hist_latest_wins(spark, d):
    h = T.history(spark, d).select("user_id", "item_type", "viewed_at", "event_id")
    return state.latest(h, ["user_id", "item_type"], "viewed_at", "event_id")


# STM-02, DAT-02
@query("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN event_type = 'view' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM events""")
def jobs_stale_expiry(spark, d):
    jobs = T.read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "RUNNING").otherwise("COMPLETED").alias("status"), F.col("ts").alias("created_at"))
    return state.expire_jobs(jobs, datetime(2024, 1, 15)).select("event_id", "status")


# DOC-07
@query(f"""WITH {SECTIONS}, kept AS (SELECT act_id, sort_order, 'kept' AS origin FROM sections WHERE verification_status IN ('VERIFIED', 'REJECTED') OR (act_id % 5 = 0 AND sort_order = 1))
SELECT * FROM kept UNION ALL SELECT act_id, sort_order, 'new' FROM sections s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.act_id = s.act_id AND k.sort_order = s.sort_order)""")
def state_lock_preserve(spark, d):
    key = F.concat_ws("/", "act_id", "sort_order")
    s = T.sections(spark, d).select(key.alias("id"), "act_id", "sort_order", F.col("sort_order").cast("string").alias("section_number"), F.col("sort_order").cast("string").alias("section_path"), "verification_status", F.lit("kept").alias("origin"))
    drafts = s.drop("id").withColumns({"verification_status": F.lit("PENDING"), "origin": F.lit("new")})
    refs = s.where("act_id % 5 = 0 AND sort_order = 1").select(F.col("id").alias("source_section_id"), F.lit("VERIFIED").alias("verification_status"))
    return state.reprocess_sections(s, drafts, refs).select("act_id", "sort_order", "origin")


# DML-05, DML-04
@query(f"WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source, CASE WHEN source = 5 THEN NULL ELSE target END AS target_act_id, CASE WHEN source = 5 THEN 'NEEDS_REVIEW' ELSE verification_status END AS verification_status FROM refs")
def state_unlink(spark, d):
    r = T.references(spark, d).withColumn("target_act_id", F.col("target").cast("string")).withColumn("target_section_id", F.lit(None).cast("string"))
    out = state.link(r, F.col("source") == 5, None, None)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "source", F.col("target_act_id").cast("bigint").alias("target_act_id"), "verification_status")


# DML-07, STM-03
@query("SELECT DISTINCT user_id, event_type AS item_type FROM events")
def state_idempotent_save(spark, d):
    keys = {"act_id": F.lit(None).cast("string"), "section_id": F.lit(None).cast("string"), "reference_id": F.lit(None).cast("string")}
    h = T.history(spark, d).select("user_id", "item_type").withColumns(keys)
    return state.save_items(h.where("item_type = 'view'").distinct(), h).select("user_id", "item_type")


# DML-06
@query(f"WITH {REFS} SELECT count(*) AS n FROM refs WHERE source <> 4")
def state_delete_cascade(spark, d):
    r = T.references(spark, d).select(F.col("source").cast("string").alias("source_act_id"), F.lit(None).cast("string").alias("target_act_id"))
    jobs = spark.createDataFrame([], "act_id string, status string")
    return state.delete_act("4", {"references": (r, "source_act_id")}, r, jobs)["references"].agg(F.count("*").alias("n"))


# PRJ-03, JOI-05: saved items of three types with their act, title and status
@query(f"""WITH {ACTS}, {SECTIONS}, {REFS}, i AS (SELECT event_id, ['ACT', 'SECTION', 'REFERENCE'][1 + event_id % 3] AS item_type, user_id, value FROM events),
r AS (SELECT l_orderkey, max_by(struct_pack(source := source, relationship := relationship, verification_status := verification_status), (l_linenumber, l_partkey, source)) AS x FROM refs GROUP BY 1),
one AS (SELECT event_id, item_type, CASE item_type WHEN 'ACT' THEN event_id % 1200 WHEN 'SECTION' THEN s.act_id ELSE (x).source END AS of_act, CASE item_type WHEN 'SECTION' THEN nullif(concat_ws(' ', 'Section ' || s.sort_order, s.heading), '') WHEN 'REFERENCE' THEN (x).relationship END AS own_title,
  CASE item_type WHEN 'SECTION' THEN s.verification_status WHEN 'REFERENCE' THEN (x).verification_status END AS own_status
  FROM i LEFT JOIN sections s ON item_type = 'SECTION' AND s.act_id = event_id % 120 AND s.sort_order = event_id % 9 LEFT JOIN r ON item_type = 'REFERENCE' AND l_orderkey = event_id)
SELECT event_id, of_act::BIGINT AS of_act, coalesce(CASE item_type WHEN 'ACT' THEN title WHEN 'SECTION' THEN coalesce(own_title, '') ELSE own_title END, 'Saved item') AS title, coalesce(own_status, processing_status) AS status FROM one LEFT JOIN acts ON acts.id = of_act""")
def catalog_saved_items(spark, d):
    k = F.col("event_id")
    kind = F.element_at(F.array(F.lit("ACT"), F.lit("SECTION"), F.lit("REFERENCE")), (1 + k % 3).cast("int"))
    items = T.read(spark, d, "events").select(
        "event_id", kind.alias("item_type"), F.when(k % 3 == 0, k % 1200).alias("act_id"), F.when(k % 3 == 1, F.concat_ws("/", k % 120, k % 9)).alias("section_id"), F.when(k % 3 == 2, k).alias("reference_id")
    )
    sections = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), "act_id", "heading", F.col("sort_order").alias("section_number"), "verification_status")
    last = F.max_by(F.struct("source", "relationship", "verification_status"), F.struct("l_linenumber", "l_partkey", "source")).alias("x")
    refs = T.references(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(last).select("id", F.col("x.source").alias("source_act_id"), F.col("x.relationship").alias("raw_reference_text"), "x.verification_status")
    return catalog.saved_items(items, T.acts(spark, d), sections, refs).select("event_id", "of_act", "title", "status")


# PRJ-04
@query(f"""WITH {ACTS}, {SECTIONS} SELECT event_id, title, heading, CASE WHEN event_id % 2 = 0 THEN '/sections/' || (event_id % 120) || '/' || (event_id % 9) ELSE '/acts/' || (event_id % 1200) END AS href
FROM events LEFT JOIN acts ON id = event_id % 1200 LEFT JOIN sections s ON event_id % 2 = 0 AND s.act_id = event_id % 120 AND s.sort_order = event_id % 9""")
def catalog_history_links(spark, d):
    k = F.col("event_id")
    items = T.read(spark, d, "events").select("event_id", (k % 1200).alias("act_id"), F.when(k % 2 == 0, F.concat_ws("/", k % 120, k % 9)).alias("section_id"))
    sections = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), "heading")
    return catalog.history_links(items, T.acts(spark, d), sections).select("event_id", "title", "heading", "href")


# SNK-03
@query("""WITH k AS (SELECT o_custkey AS id, 'key-' || (o_orderkey % 4) AS key, min((o_orderdate, 'key-' || (o_orderkey % 4))) AS first FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2),
own AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'key-' || (c_custkey % 3) END AS key FROM customer),
every AS (SELECT id, key, 0 AS part, NULL AS first FROM own WHERE key IS NOT NULL UNION ALL SELECT k.id, k.key, 1, k.first FROM k JOIN own USING (id) WHERE k.key IS DISTINCT FROM own.key)
SELECT id, coalesce(string_agg(key, ',' ORDER BY part, first), '') AS keys FROM (SELECT id FROM own) LEFT JOIN every USING (id) GROUP BY 1""")
def sink_artifact_pointers(spark, d):
    acts = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("key-"), F.col("c_custkey") % 3)).alias("extraction_artifact_key"))
    named = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("key-"), F.col("o_orderkey") % 4))
    jobs = T.read(spark, d, "orders").select(F.col("o_custkey").alias("act_id"), F.col("o_orderdate").alias("created_at"), F.to_json(F.struct(named.alias("artifact_key"))).alias("summary_json"))
    return exports.pointers(acts, jobs).select("id", F.array_join("keys", ",").alias("keys"))


# DOC-10
@query(f"""WITH {SECTIONS} SELECT act_id, sort_order, CASE WHEN sort_order % 2 = 0 THEN CASE WHEN act_id % 3 = 0 OR length(text) % 2 = 0 THEN 'STALE' ELSE 'READY' END ELSE 'FAILED' END AS embedding_status FROM sections""")
def state_mark_stale(spark, d):
    s = T.sections(spark, d).withColumns({
        "embedding_status": F.when(F.col("sort_order") % 2 == 0, "READY").otherwise("FAILED"), "embedding_provider": F.lit("p"), "embedding_model": F.when(F.col("act_id") % 3 != 0, "m"),
        "embedding_dimension": F.lit(1), "embedding_source_hash": F.when(F.length("text") % 2 == 1, X.source_hash(F.col("text"))).otherwise("old"),
    })
    return state.mark_stale(s, "p", "m", 1, X.source_hash(F.col("text"))).select("act_id", "sort_order", "embedding_status")


# JSN-03: a model's references; those that name a number that the text lacks go, and so does a payload with an unknown relationship
@query("""SELECT o_orderkey AS id, 'section ' || (o_orderkey % 50) AS raw_reference_text, CASE o_orderkey % 3 WHEN 0 THEN 'AMENDS' ELSE 'REFERS_TO' END AS relationship_type, 'Levy Act' AS target_act_title_raw, (o_orderkey % 50)::VARCHAR AS target_section_number,
  greatest(0, least(1, CASE WHEN o_orderkey % 11 = 0 THEN 0.5 ELSE (o_orderkey % 13) / 10.0 END))::DOUBLE AS confidence_score FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def json_model_payload(spark, d):
    k = F.col("o_orderkey")
    item = F.struct(
        F.concat(F.lit("section "), k % 50).alias("raw_text"), F.when(k % 7 == 0, "hates").when(k % 3 == 0, "amends").alias("relationship"), F.lit(" Levy Act ").alias("target_act_title"),
        F.when(k % 5 == 0, F.lit("99")).otherwise((k % 50).cast("string")).alias("target_section_number"), F.when(k % 11 != 0, (k % 13) / 10.0).alias("confidence"),
    )
    rows_ = T.read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("as in section "), k % 50, F.lit(" of it")).alias("text"), F.to_json(F.struct(F.array(item).alias("references"))).alias("payload"))
    return payload.references_of_payload(rows_).drop("extraction_method", "target_act_number", "target_act_year")


# JOI-13: sections of resolved acts by number, else path, else the schedule that names the path
@query(f"""WITH {SECTIONS}, s AS (SELECT act_id, sort_order, act_id || '/' || sort_order AS id, 'part ' || (sort_order + 10) AS path, sort_order = 2 AS schedule FROM sections),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 130 AS act, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS num, CASE l_linenumber % 3 WHEN 0 THEN 'part ' || (l_linenumber + 10) ELSE 'Second Schedule' END AS path FROM lineitem),
x AS (SELECT r.*, a.id AS by_number, b.id AS by_path, c.id AS by_schedule FROM r LEFT JOIN s a ON a.act_id = act AND a.sort_order = num LEFT JOIN s b ON b.act_id = act AND b.path = r.path LEFT JOIN s c ON c.act_id = act AND c.schedule AND r.path = 'Second Schedule')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(by_number, by_path, by_schedule) AS section FROM x""")
def map_sections(spark, d):
    n = F.col("sort_order")
    s = T.sections(spark, d).select(F.concat_ws("/", "act_id", n).alias("id"), "act_id", n.cast("string").alias("section_number"), F.concat(F.lit("part "), n + 10).alias("section_path"), F.when(n == 2, "SCHEDULE").otherwise("SECTION").alias("section_type"), F.lit("the SECOND schedule").alias("heading"), F.lit("x").alias("text"))
    k = F.col("l_linenumber")
    r = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 130).alias("resolved"), F.when(k % 2 == 0, k.cast("string")).alias("target_section_number"), F.when(k % 3 == 0, F.concat(F.lit("part "), k + 10)).otherwise("Second Schedule").alias("target_section_path"))
    return mapping.map_sections(r, s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "section")


# MTH-05: vectors of a hash; the first numbers by the same digest
@query(f"""WITH {SECTIONS}, t AS (SELECT act_id, sort_order, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain FROM sections),
b AS (SELECT act_id, sort_order, plain, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(unhex(sha256(plain))), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE * 2 - 1) AS v FROM t)
SELECT act_id, sort_order, round(CASE WHEN plain = '' THEN 0 ELSE v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 9) AS first, 8 AS size FROM b""")
def embed_by_hash(spark, d):
    v = embedding.hash_provider(8)("text")
    return T.sections(spark, d).select("act_id", "sort_order", v.alias("v")).select("act_id", "sort_order", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.size("v").alias("size"))


# FLT-22 facets
@query(f"WITH {ACTS} SELECT DISTINCT 'year' AS facet, year::VARCHAR AS value FROM acts UNION SELECT DISTINCT 'category', category FROM acts")
def catalog_facets(spark, d):
    return catalog.facets(T.acts(spark, d))


# --- operators over rows of the star schema -----------------------------------------------------------------


# MTH-09
@query("""SELECT p_partkey, least(round((p_size % 10) / 10.0::DOUBLE + CASE WHEN p_size % 2 = 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.04::DOUBLE ELSE 0 END, 2), 0.98::DOUBLE) AS confidence FROM part""")
def math_metadata_confidence(spark, d):
    size = F.col("p_size")
    return T.read(spark, d, "part").select("p_partkey", M.metadata_confidence((size % 10) / F.lit(10.0), size % 2 == 0, size % 3 == 0).alias("confidence"))


# DOC-03
@query("""WITH a AS (SELECT o_orderkey AS k, (o_custkey % 10) / 10.0::DOUBLE AS c FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, (o_custkey % 7) / 10.0::DOUBLE AS c FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(a.k, b.k) AS reference_key, round(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN least(a.c + 0.1::DOUBLE, 0.98::DOUBLE) ELSE coalesce(a.c, b.c) END, 4) AS confidence_score,
CASE WHEN b.k IS NOT NULL THEN 'LLM' ELSE 'REGEX' END AS extraction_method, CASE WHEN a.k IS NULL THEN 'NEEDS_REVIEW' ELSE 'PENDING' END AS verification_status
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NOT NULL OR b.c >= 0.5""")
def doc_merge_extractions(spark, d):
    o = T.read(spark, d, "orders")

    def found(rows, modulus, method):
        return rows.select(F.col("o_orderkey").alias("reference_key"), ((F.col("o_custkey") % modulus) / F.lit(10.0)).alias("confidence_score"), F.lit(method).alias("extraction_method"), F.lit("PENDING").alias("verification_status"))

    return documents.merge_extractions(found(o.where("o_orderkey % 3 <> 0"), 10, "REGEX"), found(o.where("o_orderkey % 2 = 0"), 7, "LLM"))


# MTH-12
@query("""SELECT ps, concat_ws(',', CASE WHEN chars < 40 * pages THEN 'text_density' END, CASE WHEN sections < least(5, greatest(1, pages // 20)) THEN 'sections' END,
CASE WHEN sections < 0.8 * base THEN 'fewer_sections' END, CASE WHEN spans < 0.8 * 6 THEN 'fewer_citations' END) AS errors
FROM (SELECT p_partkey AS ps, p_partkey % 3000 AS chars, p_size AS pages, p_partkey % 7 AS sections, p_partkey % 5 AS base, p_partkey % 11 AS spans FROM part)""")
def doc_quality_gate(spark, d):
    k = F.col("p_partkey")
    return T.read(spark, d, "part").select(k.alias("ps"), F.array_join(documents.quality_errors(k % 3000, F.col("p_size"), k % 7, k % 5, k % 11, F.lit(6)), ",").alias("errors"))


# SRC-09, SRC-10: a document's extractions in order of preference; the first without errors, else the baseline
@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey AS id, l_linenumber AS preference, q > 30 AS bad, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS base FROM l)
SELECT id, preference FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY bad, CASE WHEN bad THEN NOT base END NULLS FIRST, preference) = 1""")
def doc_better_source(spark, d):
    li = T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    c = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("preference"), F.when(F.col("l_quantity") > 30, F.array(F.lit("sections"))).otherwise(F.array().cast("array<string>")).alias("errors"), (F.col("l_linenumber") == last).alias("is_baseline"))
    return documents.better_source(c).select("id", "preference")


# JSN-01
@query("""WITH m AS (SELECT event_id AS id, unnest(CASE WHEN event_type = 'view' THEN ['seen', event_type] ELSE ['late ' || user_id, 'seen'] END) AS message FROM events) SELECT DISTINCT id, message FROM m""")
def json_warnings(spark, d):
    e = T.read(spark, d, "events")
    nested = F.to_json(F.struct(F.array(F.lit("seen"), F.col("event_type"), F.col("event_type")).alias("warnings"), F.lit("no").alias("note")))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("late "), F.col("user_id")).alias("errors"))).alias("pages")).alias("parse"), F.lit("seen").alias("warnings")))
    return catalog.warning_messages(e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", nested).otherwise(deep).alias("summary_json")))


# DOC-12, AGG-02, AGG-03, AGG-14
@query(f"""WITH {SECTIONS}, e AS (SELECT *, CASE sort_order % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED' ELSE 'READY' END AS st FROM sections)
SELECT count(*) AS total, count(*) FILTER (st = 'PENDING') AS pending, count(*) FILTER (st = 'READY') AS ready, count(*) FILTER (st = 'FAILED') AS failed, 0::BIGINT AS stale, count(*) FILTER (st = 'READY' AND act_id % 3 = 0) AS mismatched, 'pending,failed,identity_mismatch' AS reasons, false AS is_ready FROM e""")
def catalog_embedding_readiness(spark, d):
    turn = F.col("sort_order") % 4
    s = T.sections(spark, d).withColumns({
        "embedding_status": F.when(turn == 1, "PENDING").when(turn == 2, "FAILED").otherwise("READY"), "embedding": F.array(F.lit(1.0)), "embedding_provider": F.lit("p"),
        "embedding_model": F.when(F.col("act_id") % 3 != 0, "m"), "embedding_dimension": F.lit(1), "embedding_source_hash": F.lit("h"),
    })
    return catalog.embedding_status(s, "p", "m", 1).withColumn("reasons", F.array_join("reasons", ","))


# DOC-09, DOC-11: which sections need an embedding
@query(f"""WITH {SECTIONS} SELECT act_id, sort_order FROM sections WHERE NOT (sort_order % 2 = 0 AND act_id % 3 <> 0)""")
def state_needs_embedding(spark, d):
    s = T.sections(spark, d).withColumns({
        "embedding_status": F.when(F.col("sort_order") % 2 == 0, "READY").otherwise("STALE"), "embedding_provider": F.lit("p"), "embedding_model": F.when(F.col("act_id") % 3 != 0, "m"),
        "embedding_dimension": F.lit(1), "embedding_source_hash": F.lit("h"),
    })
    return s.where(state.needs_embedding("p", "m", 1, F.lit("h"))).select("act_id", "sort_order")


# DOC-08
@query(f"""WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source, CASE WHEN relationship = 'AMENDS' AND target IS NULL THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence_score,
CASE WHEN relationship = 'AMENDS' AND target IS NULL THEN 'NEEDS_REVIEW' ELSE verification_status END AS verification_status FROM refs""")
def state_cap_unmapped(spark, d):
    r = T.references(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "source", F.col("confidence").cast("double").alias("confidence_score"), "verification_status", F.when(F.col("relationship") == "AMENDS", "LLM").otherwise("REGEX").alias("extraction_method"),
        F.col("target").cast("string").alias("target_act_id"), F.lit(None).cast("string").alias("target_section_id"),
    )
    return state.cap_unmapped(r).select("l_orderkey", "l_linenumber", "l_partkey", "source", "confidence_score", "verification_status")


# DML-01
@query(f"WITH {SECTIONS} SELECT act_id, sort_order, CASE WHEN verification_status = 'PENDING' AND act_id % 2 = 0 THEN 'REJECTED' ELSE verification_status END AS verification_status FROM sections")
def state_decide(spark, d):
    s = T.sections(spark, d)
    return state.decide(s, (F.col("verification_status") == "PENDING") & (F.col("act_id") % 2 == 0), "REJECTED").select("act_id", "sort_order", "verification_status")


# What changes sections of T.sections: of several changes of a column the last wins
SECTION_CHANGES = """changes AS (SELECT (o_custkey % 200) || '/' || (o_orderkey % 5) AS id, o_orderkey AS n, o_orderkey % 3 <> 1 AS sets_heading, o_orderkey % 3 <> 0 AS sets_text, ' head ' || o_orderkey || ' ' AS heading,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'New-Text ' || o_orderkey END AS text FROM orders),
judged AS (SELECT *, CASE WHEN sets_text AND trim(text) = '' THEN 'blank text' END AS reason FROM changes),
snapshot AS (SELECT act_id || '/' || sort_order AS id, heading, text, verification_status FROM sections)"""


def _section_changes(spark, d):
    s = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), "heading", "text", F.lit("old").alias("normalized_text"), "verification_status")
    k = F.col("o_orderkey")
    fields = F.array_compact(F.array(F.when(k % 3 != 1, "heading"), F.when(k % 3 != 0, "text")))
    text = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit("New-Text "), k))
    changes = T.read(spark, d, "orders").select(F.concat_ws("/", F.col("o_custkey") % 200, k % 5).alias("id"), k.alias("n"), fields.alias("fields"), F.concat(F.lit(" head "), k, F.lit(" ")).alias("heading"), text.alias("text"), F.lit(None).cast("string").alias("verification_status"))
    return s, changes


# DML-02: sections, patched
@query(f"""WITH {SECTIONS}, {SECTION_CHANGES}, last AS (SELECT id, arg_max(heading, n) FILTER (sets_heading) AS h, arg_max(text, n) FILTER (sets_text) AS t FROM judged WHERE reason IS NULL GROUP BY 1)
SELECT id, coalesce(trim(h), heading) AS heading, coalesce(trim(t), text) AS text, coalesce('new text ' || split_part(trim(t), ' ', 2), 'old') AS normalized_text, verification_status FROM snapshot LEFT JOIN last USING (id)""")
def dml_patch_sections(spark, d):
    return merge.merge(*_section_changes(spark, d), "id", "n", merge.section_rules())


# DML-02: what was refused, and why
@query(f"WITH {SECTIONS}, {SECTION_CHANGES} SELECT id, n, coalesce(reason, 'not found') AS reason FROM judged WHERE reason IS NOT NULL OR id NOT IN (SELECT id FROM snapshot)")
def dml_refused_patches(spark, d):
    return merge.rejected(*_section_changes(spark, d), "id", "n", merge.section_rules())


# DML-02: acts; the search form follows the title
@query(f"""WITH {ACTS}, last AS (SELECT l_suppkey AS id, arg_max('Act ' || l_comment, l_rank) AS t FROM (SELECT l_suppkey, l_partkey || '-' || l_linenumber AS l_comment, l_orderkey * 10 + l_linenumber AS l_rank FROM lineitem WHERE l_quantity > 45) GROUP BY 1)
SELECT id, coalesce(t, title) AS title, CASE WHEN t IS NULL THEN 'old' ELSE replace(lower(t), '-', ' ') END AS normalized_title, processing_status FROM acts LEFT JOIN last USING (id)""")
def dml_patch_acts(spark, d):
    acts = T.acts(spark, d).select("id", "title", F.lit("old").alias("normalized_title"), "processing_status")
    li = T.read(spark, d, "lineitem").where("l_quantity > 45")
    changes = li.select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.array(F.lit("title")).alias("fields"), F.concat(F.lit("Act "), "l_partkey", F.lit("-"), "l_linenumber").alias("title"), F.lit(None).cast("string").alias("processing_status"))
    return merge.merge(acts, changes, "id", "n", merge.act_rules())


REF_TABLE = "refs AS (SELECT o_orderkey::VARCHAR AS id, 'section ' || o_custkey AS raw_reference_text, (o_custkey % 100)::VARCHAR AS target_act_id, 0.5::DOUBLE AS confidence_score, 'PENDING' AS verification_status FROM orders WHERE o_orderkey % 2 = 0)"


def _reference_changes(spark, d, fields):
    none = F.lit(None).cast("string")
    o = T.read(spark, d, "orders").withColumns({"id": F.col("o_orderkey").cast("string"), "raw_reference_text": F.concat(F.lit("section "), "o_custkey"), "target_act_id": (F.col("o_custkey") % 100).cast("string"), "target_section_id": none, "relationship_type": F.lit("AMENDS"), "extraction_method": F.lit("REGEX")})
    refs = o.where("o_orderkey % 2 = 0").select("id", "raw_reference_text", "relationship_type", "target_act_id", "target_section_id", F.lit(0.5).alias("confidence_score"), "extraction_method", F.lit("PENDING").alias("verification_status"))
    li = T.read(spark, d, "lineitem")
    changes = li.select(
        F.col("l_orderkey").cast("string").alias("id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("n"), F.array(*map(F.lit, fields)).alias("fields"), F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.lit("item "), "l_partkey")).alias("raw_reference_text"),
        (F.col("l_suppkey") % 120).cast("string").alias("target_act_id"), none.alias("target_section_id"), (F.col("l_tax") * 15).cast("double").alias("confidence_score"), F.when(F.col("l_returnflag") == "A", "VERIFIED").otherwise("NEEDS_REVIEW").alias("verification_status"),
    )
    return refs, changes


# DML-03: references, patched by hand; targets must be acts that exist
@query(f"""WITH {REF_TABLE}, changes AS (SELECT l_orderkey::VARCHAR AS id, l_linenumber * 100000 + l_partkey AS n, (l_suppkey % 120)::VARCHAR AS a, (l_tax * 15)::DOUBLE AS c, CASE l_returnflag WHEN 'A' THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS v FROM lineitem),
fine AS (SELECT * FROM changes WHERE NOT c > 1 AND a::INTEGER < 90), last AS (SELECT id, max((n, a)).a AS a, max((n, c)).c AS c, max((n, v)).v AS v FROM (SELECT * FROM fine) GROUP BY 1)
SELECT id, coalesce(a, target_act_id) AS target_act_id, coalesce(c, confidence_score) AS confidence_score, coalesce(v, verification_status) AS verification_status FROM refs LEFT JOIN last USING (id)""".replace("max((n, a)).a", "arg_max(a, (n, a))").replace("max((n, c)).c", "arg_max(c, (n, c))").replace("max((n, v)).v", "arg_max(v, (n, v))"))
def dml_patch_references(spark, d):
    refs, changes = _reference_changes(spark, d, ("target_act_id", "confidence_score", "verification_status"))
    acts = spark.range(90).select(F.col("id").cast("string").alias("id"))
    sections = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), F.col("act_id").cast("string").alias("act_id"))
    judged = merge.with_valid_targets(changes, refs, acts, sections)
    return merge.merge(refs, judged, "id", "n", merge.reference_rules(False, "u1", targets=True)).select("id", "target_act_id", "confidence_score", "verification_status")


# DML-03: references made by hand where there are none, with defaults for what they do not say
@query(f"""WITH {REF_TABLE}, fresh AS (SELECT l_orderkey::VARCHAR AS id, 'item ' || arg_max(l_partkey, l_linenumber * 100000 + l_partkey) AS raw_reference_text FROM lineitem WHERE l_linenumber <> 7 AND l_orderkey::VARCHAR NOT IN (SELECT id FROM refs) GROUP BY 1)
SELECT id, raw_reference_text, 'REGEX' AS extraction_method, 'PENDING' AS verification_status FROM refs UNION ALL SELECT id, raw_reference_text, 'MANUAL', 'NEEDS_REVIEW' FROM fresh""")
def dml_create_references(spark, d):
    refs, changes = _reference_changes(spark, d, ("raw_reference_text",))
    return merge.merge(refs, changes, "id", "n", merge.reference_rules(True)).select("id", "raw_reference_text", "extraction_method", "verification_status")


# DML-08: gold judgements, each identity once, the first one stays
@query("""SELECT event_id AS id, user_id AS query_id, 0 AS relevance_grade FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_id % 4 <> 0 AND event_id % 3 <> 0""")
def dml_insert_gold(spark, d):
    e = T.read(spark, d, "events")
    gold = e.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("query_id"), F.lit(0).alias("relevance_grade"))
    new = e.select(F.col("event_id").alias("id"), F.lit(1).alias("n"), F.array(F.lit("query_id"), F.lit("relevance_grade")).alias("fields"), F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 3 == 0, 5).otherwise(2).alias("relevance_grade"))
    return merge.merge(gold, new, "id", "n", merge.gold_rules())


# DOC-09, DOC-11, SRT-12: a backfill in key batches, ended by a limit and resumed
@query(f"""WITH {SECTIONS}, s AS (SELECT lpad(act_id::VARCHAR, 9, '0') || '/' || sort_order AS id, text, sort_order % 3 AS k FROM sections)
SELECT id, CASE WHEN k = 2 THEN 'FAILED' ELSE 'READY' END AS embedding_status, CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN length(text) END::DOUBLE AS first FROM s""")
def backfill_resumed(spark, d):
    k = F.col("sort_order") % 3
    digest = F.sha2(F.col("text").cast("binary"), 256)
    s = T.sections(spark, d).select(
        F.concat(F.lpad(F.col("act_id").cast("string"), 9, "0"), F.lit("/"), "sort_order").alias("id"), "text", F.when(k == 0, F.array(F.lit(1.0))).cast("array<double>").alias("embedding"), F.when(k == 0, "READY").when(k == 1, "STALE").otherwise("FAILED").alias("embedding_status"),
        F.lit("p").alias("embedding_provider"), F.lit("m").alias("embedding_model"), F.lit(1).alias("embedding_dimension"), F.when(k == 0, digest).otherwise("old").alias("embedding_source_hash"),
    )
    path, vector, target = storage.fresh_path(spark, "backfill"), F.array(F.length("text").cast("double")), backfill.Target("p", "m", 1)
    batch = s.count() // 8 + 1
    backfill.run(s, path, vector, target, digest, batch_rows=batch, limit=batch)
    backfill.run(s, path, vector, target, digest, batch_rows=batch)
    return backfill.merged(s, path).select("id", "embedding_status", F.get("embedding", F.lit(0)).alias("first"))


# DML-10
@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'RUNNING' ELSE 'QUEUED' END AS status, CASE WHEN event_type = 'view' THEN 40 ELSE 0 END::INTEGER AS progress_percent, CASE WHEN event_type = 'view' THEN 'parse' ELSE '' END AS current_step FROM events""")
def state_advance_job(spark, d):
    none = F.lit(None).cast("timestamp_ntz")
    jobs = T.read(spark, d, "events").select("event_id", "event_type", F.lit("QUEUED").alias("status"), F.lit("").alias("current_step"), F.lit(0).alias("progress_percent"), none.alias("started_at"), none.alias("completed_at"))
    return state.advance_job(jobs, F.col("event_type") == "view", "parse", 40, datetime(2024, 1, 15)).select("event_id", "status", "progress_percent", "current_step")


# DML-03: references whose target section belongs to another act
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 1 AND NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id = l_suppkey AND turn = l_linenumber)")
def state_invalid_targets(spark, d):
    s = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), F.col("act_id").cast("string").alias("act_id"))
    r = T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").cast("string").alias("target_act_id"),
        F.when(F.col("l_linenumber") != 1, F.concat_ws("/", "l_suppkey", "l_linenumber")).alias("target_section_id"),
    )
    return state.invalid_targets(r, s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# FLT-04, FLT-29
@query(f"WITH {REFS} SELECT l_orderkey, l_linenumber, l_partkey, source FROM refs WHERE verification_status = 'VERIFIED'")
def flt_lawyer_listing(spark, d):
    return T.references(spark, d).where(V.listed_references("LAWYER", F.col("verification_status"))).select("l_orderkey", "l_linenumber", "l_partkey", "source")


# STR-29, STR-30
@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Act No. ' || p_size || ' of 1999' WHEN 1 THEN 'Chapter ' || p_size ELSE 'Unmatched target' END AS shown, p_size % 3 = 2 AS internal FROM part""")
def str_unresolved_label(spark, d):
    k, size = F.col("p_size") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 1, F.concat(F.lit("chapter "), size)).otherwise(F.concat(F.lit("section "), size))
    number, year, title = F.when(k == 0, size), F.when(k == 0, 1999), F.lit(None).cast("string")
    return T.read(spark, d, "part").select("p_partkey", graph.unresolved_label(title, raw, number, year).alias("shown"), graph.is_internal_citation(number, year, title, raw).alias("internal"))


# --- documents: synthetic statutes, so that SQL can say what is in them -----------------------------------


# DOC-01, WIN-02, WIN-03, WIN-04, WIN-10, SRT-09
@query("""WITH p AS (SELECT *, p_partkey AS id, p_size % 4 + 1 AS n FROM part), s AS (
  SELECT id, 0 AS k, 'PREAMBLE' AS section_number, 'PREAMBLE' AS section_type, 'Preamble' AS heading, 'Be it enacted as follows:' AS text FROM p
  UNION ALL SELECT id, 1, 'PART I', 'PART', 'PART I' || chr(10) || 'GENERAL', 'PART I' || chr(10) || 'GENERAL' FROM p WHERE id % 2 = 0
  UNION ALL SELECT id, 2, '1', 'SECTION', 'Short title', 'Short title' || chr(10) || '1. This Act may be cited as the ' || p_name || ' Act.' FROM p
  UNION ALL SELECT id, 3, '2', 'SECTION', 'Powers', '2. Powers; and more.' || chr(10) || chr(10) || '  Text of ' || p_brand || '.' FROM p WHERE n >= 2
  UNION ALL SELECT id, 4, '3', 'SECTION', 'Amendment of section ' || p_size || ' of the principal enactment', 'Amendment of section ' || p_size || ' of the principal enactment' || chr(10) || '3. Section ' || p_size || ' of the '
    || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' Act, No. 7 of ' || (id % 40 + 1980) || ' is hereby amended.' FROM p WHERE n >= 3
  UNION ALL SELECT id, 5, 'PART II', 'PART', 'PART II', 'PART II' FROM p WHERE id % 3 = 0
  UNION ALL SELECT id, 6, '4', 'SECTION', 'Powers of ' || p_brand, '4.' || chr(10) || 'Powers of ' || p_brand || chr(10) || 'as in section 5.' FROM p WHERE n >= 4
  UNION ALL SELECT id, 7, 'FIRST SCHEDULE', 'SCHEDULE', 'FIRST SCHEDULE', 'FIRST SCHEDULE' || chr(10) || '1. Form of ' || p_type FROM p WHERE id % 5 = 0)
SELECT id, section_number, section_type, heading, text, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS sort_order, true AS found FROM s""")
def doc_segment(spark, d):
    acts = T.statutes(spark, d)
    s = segments.segment(acts).join(acts.select("id", "raw_text").hint("merge"), "id")  # texts are made from a small table, by whose size they would be broadcast
    held = F.substr("raw_text", F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    return s.select("id", "section_number", "section_type", "heading", "text", "sort_order", held.contains(F.col("text")).alias("found"))


# AGG-12
@query("""SELECT p_partkey AS id, (p_size % 4 + 1)::BIGINT AS sections_detected, (p_partkey % 5 = 0)::BIGINT AS schedules_detected, ((p_partkey % 2 = 0)::BIGINT + (p_partkey % 3 = 0)::BIGINT)::BIGINT AS parts_detected, false AS fallback_used, true AS preamble_kept FROM part""")
def doc_segment_summary(spark, d):
    return segments.summary(segments.segment(T.statutes(spark, d)))


# JOI-20: what keeps an act from being deleted
@query(f"""WITH {ACTS}, {SECTIONS}, r AS (SELECT l_suppkey AS source, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 40 END AS act, CASE WHEN l_linenumber % 2 = 0 THEN s.act_id END AS owner FROM lineitem LEFT JOIN sections s ON l_linenumber % 2 = 0 AND s.act_id = l_partkey % 90 AND s.sort_order = l_linenumber),
hits AS (SELECT act AS target FROM r WHERE act IS NOT NULL AND act <> source UNION ALL SELECT owner FROM r WHERE owner IS NOT NULL AND owner <> source AND owner IS DISTINCT FROM act),
i AS (SELECT target, count(*) AS n FROM hits GROUP BY 1), j AS (SELECT event_id % 300 AS act, count(*) AS n FROM events WHERE event_type = 'view' AND event_id % 300 > 150 GROUP BY 1)
SELECT id, coalesce(j.n, 0) AS active_jobs, coalesce(i.n, 0) AS incoming, j.n IS NULL AND i.n IS NULL AS deletable FROM acts LEFT JOIN i ON target = id LEFT JOIN j ON j.act = id""")
def state_delete_guards(spark, d):
    k = F.col("l_linenumber")
    refs = T.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_act_id"), F.when(k % 3 == 0, F.col("l_partkey") % 40).alias("target_act_id"), F.when(k % 2 == 0, F.concat_ws("/", F.col("l_partkey") % 90, k)).alias("target_section_id"))
    sections = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), "act_id")
    e = T.read(spark, d, "events").where(F.col("event_id") % 300 > 150)
    jobs = e.select((F.col("event_id") % 300).alias("act_id"), F.when(F.col("event_type") == "view", "RUNNING").otherwise("COMPLETED").alias("status"))
    return state.delete_guards(T.acts(spark, d).select("id"), refs, sections, jobs)


# DOC-06
@query(f"""WITH {REFS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, l_orderkey, l_linenumber, l_partkey) AS pos FROM refs)
SELECT source AS source_act_id, arg_min(target, pos) AS act, arg_min('line ' || l_linenumber, pos) AS cited FROM r WHERE target IS NOT NULL AND l_linenumber <> 5 GROUP BY 1""")
def doc_context_preview(spark, d):
    order = Window.partitionBy("source").orderBy("created_at", "l_orderkey", "l_linenumber", "l_partkey")
    mapped = T.references(spark, d).select(F.col("source").alias("source_act_id"), F.row_number().over(order).alias("position"), F.col("target").alias("own"), (F.col("l_linenumber") == 5).alias("principal"), F.concat(F.lit("line "), "l_linenumber").alias("raw_reference_text"))
    return mapping.context_preview(mapped)


# SRC-10: the native extraction, unless a page of it is sparse or it misses the gate
@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey AS id, l_linenumber AS preference, l_linenumber = max(l_linenumber) OVER w AS base, q > 30 OR (l_linenumber = max(l_linenumber) OVER w AND q < 10) AS bad FROM l WINDOW w AS (PARTITION BY l_orderkey))
SELECT id, preference FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY bad, CASE WHEN bad THEN NOT base END NULLS FIRST, CASE WHEN base THEN -1 ELSE preference END) = 1""")
def doc_native_first(spark, d):
    li = rows.dealt(T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", F.lit(64)).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    last = F.col("l_linenumber") == F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    pages = F.array(F.lit("a page of text that is long enough"), F.when(F.col("q") < 10, "   sparse  ").otherwise("another page, as long as it"))
    errors = F.when(F.col("q") > 30, F.array(F.lit("sections"))).otherwise(F.array().cast("array<string>"))
    c = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("preference"), errors.alias("errors"), last.alias("is_baseline"), last.alias("is_native"), pages.alias("pages"))
    return documents.native_first(c).select("id", "preference")


# DOC-01 over prose: a text without a numbered section is one row
@query()
def doc_segment_prose(spark, d):
    return segments.segment(T.acts(spark, d).select("id", "raw_text"))


CITING = "'Section ' || p_size || ' of the Levies (Region ' || p_partkey || ') Act, No. ' || (p_size + 1) || ' of 1999 is hereby amended. See section 12 here. The powers under section ' || (p_size + 2) || ';' || CASE WHEN p_partkey % 2 = 0 THEN ' the Second Schedule is for the levies.' ELSE '' END"


# DOC-02, STR-15, STR-16, STR-17
@query(f"""WITH p AS (SELECT *, p_partkey AS id, {CITING} AS t FROM part), r AS (
  SELECT id, 0 AS k, 'Section ' || p_size || ' of the Levies (Region ' || id || ') Act, No. ' || (p_size + 1) || ' of 1999 is hereby amended' AS raw_reference_text, 'AMENDS' AS relationship_type,
    'Levies (Region ' || id || ') Act' AS target_act_title_raw, (p_size + 1)::VARCHAR AS target_act_number, p_size::VARCHAR AS target_section_number, p_size::VARCHAR AS target_section_path, 0.95::DOUBLE AS confidence_score, 'PENDING' AS verification_status, t FROM p
  UNION ALL SELECT id, 1, 'Section ' || p_size || ' of the Levies (Region ' || id || ') Act, No. ' || (p_size + 1) || ' of 1999', 'AMENDS', 'Levies (Region ' || id || ') Act', (p_size + 1)::VARCHAR, NULL, NULL, 0.95, 'PENDING', t FROM p
  UNION ALL SELECT id, 2, 'section ' || (p_size + 2), 'CROSS_REFERENCE', NULL, NULL, (p_size + 2)::VARCHAR, (p_size + 2)::VARCHAR, 0.7, 'PENDING', t FROM p
  UNION ALL SELECT id, 3, 'Second Schedule', 'UNKNOWN', NULL, NULL, NULL, 'Second Schedule', 0.3, 'NEEDS_REVIEW', t FROM p WHERE id % 2 = 0)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS position, raw_reference_text, relationship_type, target_act_title_raw, target_act_number, target_section_number, target_section_path, confidence_score, verification_status,
  trim(substr(t, greatest(1, strpos(t, raw_reference_text) - 160), least(160, strpos(t, raw_reference_text) - 1) + length(raw_reference_text) + CASE WHEN k = 3 THEN 161 ELSE 160 END)) AS context_snippet FROM r""")
def doc_extract_refs(spark, d):
    size = lambda n: (F.col("p_size") + n).cast("string")
    text = F.concat(F.lit("Section "), "p_size", F.lit(" of the Levies (Region "), "p_partkey", F.lit(") Act, No. "), size(1), F.lit(" of 1999 is hereby amended. See section 12 here. The powers under section "), size(2), F.lit(";"),
                    F.when(F.col("p_partkey") % 2 == 0, " the Second Schedule is for the levies.").otherwise(""))
    found = citations.extract_references(T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))
    return found.drop("target_act_year", "extraction_method")


MAPPED = """WITH a AS (SELECT p_name, min(p_partkey::VARCHAR) AS act FROM part GROUP BY 1),
l AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, l_suppkey::VARCHAR AS source_act_id, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN act END AS own,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem JOIN part ON l_partkey = p_partkey JOIN a USING (p_name)),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY source_act_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM l),
r AS (SELECT *, own IS NULL AND context IS NOT NULL AS used_context, coalesce(own, context) AS resolved, CASE WHEN own IS NOT NULL THEN 'exact' WHEN context IS NOT NULL THEN 'inferred' END AS match FROM c),
s AS (SELECT r.*, CASE WHEN turn IS NOT NULL THEN resolved || '/' || l_linenumber END AS section FROM r LEFT JOIN conversations ON conv_id::VARCHAR = resolved AND turn = l_linenumber),
mapped AS (SELECT *, CASE WHEN resolved IS NULL THEN 0.55 WHEN match = 'exact' THEN CASE WHEN section IS NULL THEN 0.92 ELSE 0.98 END WHEN section IS NULL THEN 0.68 ELSE 0.78 END::DOUBLE AS confidence FROM s)"""


def _mapped(spark, d):
    """Every line cites a part's act by title; some leave it to context."""
    acts = T.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), X.search_form(F.concat("p_name", F.lit(" act"))).alias("normalized_title"), F.col("p_size").cast("string").alias("act_number"), (F.col("p_partkey") % 40 + 1980).cast("int").alias("year"), F.col("p_brand").alias("source_name"))
    sections = T.sections(spark, d).select(F.concat_ws("/", "act_id", "sort_order").alias("id"), F.col("act_id").cast("string").alias("act_id"), F.col("sort_order").cast("string").alias("section_number"), F.col("sort_order").cast("string").alias("section_path"), F.lit("SECTION").alias("section_type"), "heading", "text")
    li = T.read(spark, d, "lineitem").join(T.read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    names = F.col("l_linenumber") % 3 != 0
    position = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    none = F.lit(None).cast("string")
    refs = li.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_suppkey").cast("string").alias("source_act_id"), position.alias("position"), F.when(names, F.concat("p_name", F.lit(" Act"))).otherwise(F.concat(F.lit("section "), F.col("l_linenumber"))).alias("raw_reference_text"),
        F.when(F.col("l_returnflag") == "A", "AMENDS").otherwise("REPEALS").alias("relationship_type"), F.when(names, F.concat(F.initcap("p_name"), F.lit(" Act"))).alias("target_act_title_raw"), none.alias("target_act_number"), F.lit(None).cast("int").alias("target_act_year"),
        F.col("l_linenumber").cast("string").alias("target_section_number"), none.alias("target_section_path"), none.alias("target_act_id"), none.alias("target_section_id"), F.lit("PENDING").alias("verification_status"),
    )
    return mapping.map_references(refs, acts, sections)


# DOC-04, DOC-05, DOC-06
@query(MAPPED + " SELECT id, source_act_id, position::INTEGER AS position, resolved, section, match, confidence, resolved IS NULL OR confidence < 0.85 AS needs_review, used_context FROM mapped")
def doc_map_refs(spark, d):
    return _mapped(spark, d).select("id", "source_act_id", "position", "resolved", "section", "match", "confidence", "needs_review", "used_context")


# AGG-11
@query(MAPPED + """ SELECT count(resolved) AS mapped_acts, count(section) AS mapped_sections, count(*) - count(resolved) AS unresolved, count(*) FILTER (used_context) AS context_used,
count(*) FILTER (match = 'exact') AS exact, 0::BIGINT AS partial, count(*) FILTER (match = 'inferred') AS inferred FROM mapped""")
def agg_mapping_summary(spark, d):
    return mapping.mapping_summary(_mapped(spark, d))


# STR-21
@query("""SELECT p_partkey AS id, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' Act' AS title, p_name || ' act' AS normalized_title, p_size::VARCHAR AS act_number,
(p_partkey % 40 + 1980)::INTEGER AS year, NULL::DATE AS publication_date FROM part""")
def meta_extract(spark, d):
    return documents.metadata(T.statutes(spark, d)).drop("certification_date", "confidence")


# STR-18, STR-19, HYB-03: the boost of an exact identifier over all acts
@query(f"WITH {ACTS} SELECT id, CASE WHEN act_number = '9' AND year = 1987 THEN 200.0::DOUBLE ELSE 0 END AS boost FROM acts")
def intent_boost(spark, d):
    intent = Q.parse("Act No. 9 of 1987")
    return T.acts(spark, d).select("id", search.fallback_boost(Q.act_boost(intent, F.col("act_number"), F.col("year"), F.col("title"))).alias("boost"))
