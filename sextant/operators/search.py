"""Keyword, nearest-neighbour and hybrid search, each as one plan from filter to page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import scoring as M
from sextant.functions import text as X
from sextant.operators import intent as Q
from sextant.operators import visibility as V


def _any(*conditions: Column) -> Column:
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def _like(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{text}%")


def act_hits(acts: DataFrame, query: str, role: str, filters: Column | None = None, act_number: str | None = None) -> DataFrame:
    """Visible acts that match, with ``score``; ``acts`` needs normalized_title and the other act columns."""
    intent, plain = Q.parse(query), Q.plain(query)
    rows = acts.where(V.acts(role, F.col("processing_status")) & (F.lit(True) if filters is None else filters)).withColumn("_low", F.lower("raw_text"))
    score = F.lit(0.3)
    title = F.col("normalized_title")
    if query:
        stored = {"number": F.col("act_number"), "year": F.col("year"), "title": title}
        exact = [Q.matches({kind: intent[kind]}, **stored) for kind in ("act_number", "act_title") if kind in intent]
        names = ("act_number", "category", "source_name", "source_file_name")
        rows = rows.where(_any(_like("normalized_title", plain), F.col("year").cast("string").ilike(f"%{query}%"), *(_like(c, query) for c in names if c in acts.columns), F.col("_low").like(f"%{query.lower()}%"), *exact))
        score = score + F.when(title == plain, 9.0).when(title.contains(plain), 5.5).otherwise(0.0)
        score = score + F.when((F.lit(bool(act_number)) & (F.col("act_number") == (act_number or ""))) | (F.col("act_number") == query), 4.5).otherwise(0.0)
        score = score + F.when(F.col("year").cast("string") == query, 2.0).otherwise(0.0)
        score = score + F.when(X.search_form(F.col("category")).contains(plain), 1.5).otherwise(0.0)
        score = score + F.when(F.col("_low").contains(query.lower()), 0.8).otherwise(0.0)
    seen = F.when(F.col("processing_status") == "VERIFIED", 0.3)
    score = score + (seen if role == "ADMIN" else seen.when(F.col("processing_status") == "PROCESSED", 0.15)).otherwise(0.0)
    score = score + Q.act_boost(intent, F.col("act_number"), F.col("year"), F.col("title"))
    return rows.select(F.lit("ACT").alias("result_type"), F.col("id").cast("string").alias("id"), "title", "year", "category", "processing_status", X.snippet(F.col("raw_text"), query).alias("snippet"), F.round(score, 6).alias("score"))


def section_hits(sections: DataFrame, acts: DataFrame, query: str, role: str, filters: Column | None = None, verification: str | None = None) -> DataFrame:
    """Visible sections (of visible acts) that match, with ``score``."""
    intent, plain = Q.parse(query), Q.plain(query)
    a = acts.select(F.col("id").alias("act_id"), "title", "normalized_title", "act_number", "year", "category", "processing_status")
    rows = sections.join(a, "act_id").where(V.acts(role, F.col("processing_status")) & V.sections(role, F.col("verification_status")))
    rows = rows.where(F.lit(True) if filters is None else filters)
    if role != "GENERAL_USER":
        rows = rows.where(V.verification(verification, F.col("verification_status")))
    score = F.lit(0.25)
    if query:
        wanted = _any(F.col("section_number") == query, _like("section_path", query), _like("heading", query), _like("normalized_title", plain), _like("normalized_text", plain), Q.matches(intent, section=F.col("section_number"), path=F.col("section_path")))
        rows = rows.where(wanted)
        heading = X.search_form(F.col("heading"))
        score = score + F.when(_any(F.col("section_number") == query, F.col("section_path") == query), 5.5).otherwise(0.0)
        score = score + F.when(heading == plain, 5.0).when((heading != "") & heading.contains(plain), 3.6).otherwise(0.0)
        score = score + F.when(F.col("normalized_text").contains(plain), 1.6).otherwise(0.0) + F.when(F.col("normalized_title").contains(plain), 1.2).otherwise(0.0)
    score = score + F.when(F.col("verification_status") == "VERIFIED", 0.2 if role == "ADMIN" else 0.4).otherwise(0.0)
    score = score + Q.section_boost(intent, F.col("act_number"), F.col("year"), F.col("title"), F.col("section_number"), F.col("section_path"))
    return rows.select(F.lit("SECTION").alias("result_type"), F.col("id").cast("string").alias("id"), "title", "year", "category", "processing_status", "section_number", "section_path", F.col("heading").alias("section_heading"), "verification_status", X.snippet(F.col("text"), query).alias("snippet"), F.round(score, 6).alias("score"))


def reference_hits(references: DataFrame, acts: DataFrame, query: str, role: str, filters: Column | None = None, relationship: str | None = None, verification: str | None = None, mapped: str | None = None) -> DataFrame:
    """Visible references (of visible source acts) that match, with ``score``."""
    kind = Q.parse(query).get("relationship")
    a = acts.select(F.col("id").alias("source_act_id"), "title", "act_number", "year", "category", "processing_status")
    is_mapped = V.mapped(F.col("target_act_id"), F.col("target_section_id"))
    rows = references.join(a, "source_act_id").where(V.acts(role, F.col("processing_status")) & V.references(role, F.col("verification_status"), is_mapped))
    rows = rows.where((F.lit(True) if filters is None else filters) & V.mapped_status(mapped, is_mapped))
    if relationship:
        rows = rows.where(F.col("relationship_type") == relationship)
    if role != "GENERAL_USER":
        rows = rows.where(V.verification(verification, F.col("verification_status")))
    score = 0.2 + F.coalesce("confidence_score", F.lit(0.0))
    score = score + F.when(F.col("relationship_type") == relationship, 2.5).otherwise(0.0) if relationship else score
    if query:
        names = ("raw_reference_text", "context_snippet", "target_act_title_raw", "target_act_number", "target_section_number", "target_section_path")
        extra = [F.col("relationship_type") == kind] if kind else []
        rows = rows.where(_any(*(_like(c, query) for c in names), F.col("target_act_year").cast("string").ilike(f"%{query}%"), *extra))
        low = query.lower()
        has = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
        for column, worth in (("raw_reference_text", 2.4), ("context_snippet", 1.5), ("target_act_title_raw", 1.8), ("target_section_path", 1.4)):
            score = score + F.when(has(column), worth).otherwise(0.0)
        score = score + F.when(F.lower("target_section_number") == low, 2.0).otherwise(0.0)
        score = score + F.when(F.col("relationship_type") == kind, 3.2).otherwise(0.0) if kind else score
    score = score + F.when(F.col("verification_status") == "VERIFIED", 0.2 if role == "ADMIN" else 0.4).otherwise(0.0) + F.when(is_mapped, 0.2).otherwise(0.0)
    return rows.select(F.lit("REFERENCE").alias("result_type"), F.col("id").cast("string").alias("id"), "title", "year", "category", "processing_status", "relationship_type", "verification_status", X.snippet(F.col("context_snippet"), query).alias("snippet"), F.round(score, 6).alias("score"))


def page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page in rank order; Spark keeps offset + limit rows per task, not a global sort."""
    return hits.orderBy(F.col("score").desc(), "result_type", "title", "id").offset(offset).limit(limit)


def union_hits(*hits: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("result_type").agg(F.count("*").alias("n"))


def nearest(rows: DataFrame, query: Sequence[float], k: int, offset: int = 0, exact: Column | None = None, id_column: str = "section_id") -> DataFrame:
    """The k nearest rows by cosine distance; rows where ``exact`` holds come first, nulls count as not.

    One expression per row and a top-k: nothing is shuffled but each task's best rows.
    """
    distance = F.round(M.cosine_distance(F.col("embedding"), M.as_vector(query)), 9)
    tier = F.coalesce(exact, F.lit(False)) if exact is not None else F.lit(False)
    ranked = rows.withColumns({"distance": distance, "tier": tier}).orderBy(F.col("tier").desc(), "distance", id_column)
    return ranked.offset(offset).limit(k).withColumn("score", M.similarity_score(F.col("distance")))


def first_ranks(ranked_: DataFrame, identity: Sequence[str], name: str, boost: str | None = None) -> DataFrame:
    """Each identity once, with its best rank and its greatest boost."""
    extra = [F.max(boost).alias(f"{name}_boost")] if boost else []
    return ranked_.groupBy(*identity).agg(F.min("rank").alias(f"{name}_rank"), *extra)


def fuse(keyword: DataFrame, semantic: DataFrame, identity: Sequence[str] = ("result_type", "id"), k: int = M.RRF_K, weights: tuple[float, float] = (1.0, 1.0), boost: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (identity columns, ``rank``; ``boost`` optional).

    An identity that a list repeats keeps its first rank, and ranks are not renumbered.
    """
    keys = list(identity)
    both = first_ranks(keyword, keys, "keyword", boost).join(first_ranks(semantic, keys, "semantic", boost), keys, "full_outer")
    a, b = M.rrf(F.col("keyword_rank"), weights[0], k), M.rrf(F.col("semantic_rank"), weights[1], k)
    plus = F.greatest(F.coalesce("keyword_boost", F.lit(0.0)), F.coalesce("semantic_boost", F.lit(0.0))) if boost else F.lit(0.0)
    return both.withColumns({"keyword_contribution": a, "semantic_contribution": b, "boost": plus}).withColumn("score", F.round(a + b + plus, 9))


def fused_page(fused: DataFrame, limit: int, offset: int = 0, identity: Sequence[str] = ("result_type", "id"), role: str = "ADMIN") -> DataFrame:
    """A page of a fusion; only administrators see the components."""
    out = fused.orderBy(F.col("score").desc(), *identity).offset(offset).limit(limit)
    return out if role == "ADMIN" else out.select(*identity, "score")


def fallback_boost(score: Column) -> Column:
    return F.when(score >= M.BOOST, M.BOOST).otherwise(0.0)


def mode(requested: str, semantic_ready: bool, query: str, relationship: str | None = None, mapped: str | None = None) -> str:
    """semantic if asked for; hybrid if all is asked for, vectors are ready and they apply; else keyword."""
    if requested == "semantic":
        return "semantic"
    applies = bool(query) and not relationship and not mapped
    return "hybrid" if requested == "all" and semantic_ready and applies else "keyword"


def ranked(hits: DataFrame, *order: Column, pool: int = 100) -> DataFrame:
    """The first ``pool`` hits with their ranks: a bounded candidate list for fusion."""
    top = hits.orderBy(*order).limit(pool)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def suggest(titles: DataFrame, text: str, limit: int = 8) -> DataFrame:
    return titles.where(V.contains_literal(F.col("title"), text)).select("id", "title").orderBy("title", "id").limit(limit)
