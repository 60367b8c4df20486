"""From texts to sections, references and resolved targets in one go, without state in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators import citations, documents, mapping, segments, state


@dataclass(frozen=True)
class Ingested:
    acts: DataFrame
    sections: DataFrame
    references: DataFrame


def ingest(texts: DataFrame, acts: DataFrame | None = None) -> Ingested:
    """``texts``: id, source_file_name, raw_text. References resolve against ``acts`` (default: the ingested ones).

    Section and reference ids are digests of what they are, so that a rerun gives the same ids.
    """
    cleaned = texts.withColumn("raw_text", X.clean(F.coalesce("raw_text", F.lit(""))))
    found = documents.metadata(cleaned).join(texts.select("id", "source_file_name"), "id").withColumn("source_name", F.lit(None).cast("string"))
    ident = lambda *c: F.substring(F.sha2(F.concat_ws("\x1f", *c).cast("binary"), 256), 1, 32)
    parts = segments.segment(cleaned).drop("position").withColumnRenamed("id", "act_id")
    sections = parts.withColumns({"id": ident("act_id", F.col("sort_order").cast("string"), "section_number"), "verification_status": F.lit("PENDING")})
    refs = citations.extract_references(sections.select("id", "text")).withColumnsRenamed({"id": "source_section_id", "position": "_k"})
    refs = refs.join(sections.select(F.col("id").alias("source_section_id"), F.col("act_id").alias("source_act_id"), "sort_order"), "source_section_id")
    order = Window.partitionBy("source_act_id").orderBy("sort_order", "_k")
    none = F.lit(None).cast("string")
    refs = refs.withColumns({"position": F.row_number().over(order), "id": ident("source_section_id", F.col("_k").cast("string"), "raw_reference_text"), "target_act_id": none, "target_section_id": none})
    mapped = mapping.map_references(refs.drop("_k", "sort_order"), found if acts is None else acts, sections)
    mapped = mapped.withColumns({"target_act_id": F.col("resolved"), "target_section_id": F.col("section"), "confidence_score": F.col("confidence"), "verification_status": F.when(F.col("needs_review"), "NEEDS_REVIEW").otherwise(F.col("verification_status"))})
    return Ingested(found, sections, state.cap_unmapped(mapped))
