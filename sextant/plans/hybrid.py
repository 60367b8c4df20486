"""A search from query to page: mode, candidates, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import scoring as M
from sextant.operators import intent as Q
from sextant.operators import search
from sextant.operators import visibility as V

POOL = 100


def search_page(acts: DataFrame, sections: DataFrame, references: DataFrame, query: str, role: str = "GENERAL_USER", requested: str = "all", vector: Sequence[float] | None = None,
                limit: int = 20, offset: int = 0, relationship: str | None = None, mapped: str | None = None, **filters) -> tuple[str, DataFrame]:
    """(mode, page). ``vector`` is the query's embedding; None means that semantic search is not ready."""
    text, limit, offset = Q.guard(query, limit, offset)
    mode = search.mode(requested, vector is not None, text, relationship, mapped)
    where = V.metadata(**filters)
    if mode == "semantic":
        if vector is None:
            raise ValueError("semantic search is not ready")
        return mode, _semantic(acts, sections, text, role, vector, where, limit, offset)
    refs = search.reference_hits(references, acts, text, role, where, relationship, mapped=mapped)
    hits = refs if relationship or mapped else search.union_hits(search.act_hits(acts, text, role, where), search.section_hits(sections, acts, text, role, where), refs)
    if mode == "keyword":
        return mode, search.page(hits, limit, offset)
    order = (F.col("score").desc(), F.col("result_type"), F.col("title"), F.col("id"))
    keyword = search.ranked(hits, *order, pool=POOL).withColumn("boost", search.fallback_boost(F.col("score")))
    near = _semantic(acts, sections, text, role, vector, where, POOL, 0)
    semantic = search.ranked(near, F.col("tier").desc(), F.col("distance"), F.col("id"), pool=POOL).withColumn("boost", F.when(F.col("tier"), M.BOOST).otherwise(0.0))
    return mode, search.fused_page(search.fuse(keyword, semantic, boost="boost"), limit, offset, role=role)


def _semantic(acts: DataFrame, sections: DataFrame, text: str, role: str, vector: Sequence[float], where, limit: int, offset: int) -> DataFrame:
    a = acts.select(F.col("id").alias("act_id"), "title", "normalized_title", "act_number", "year", "category", "processing_status")
    rows = sections.where(F.col("embedding").isNotNull()).join(a, "act_id").where(V.acts(role, F.col("processing_status")) & V.sections(role, F.col("verification_status")) & where)
    near = search.nearest(rows, vector, limit, offset, exact=Q.exact_section(Q.parse(text)), id_column="id")
    return near.select(F.lit("SECTION").alias("result_type"), "id", "title", "tier", "distance", "score")
