"""References proposed by a model, as JSON beside the text they should come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.schemas import RELATIONSHIPS

ITEM = "raw_text string, relationship string, target_act_title string, target_act_number string, target_act_year int, target_section_number string, confidence double"


def invented(numbers: Column, item: Column) -> Column:
    """Whether an item names a number, year or section that the text does not contain."""
    digits = F.regexp_replace(item["target_section_number"], r"\D", "")
    absent = lambda v: F.coalesce((v != "") & ~F.array_contains(numbers, v), F.lit(False))
    return absent(item["target_act_number"]) | absent(item["target_act_year"].cast("string")) | absent(digits)


def references_of_payload(df: DataFrame, key: str = "id", text: str = "text", payload: str = "payload") -> DataFrame:
    """One row for each acceptable item; a payload that does not parse, or has an unknown relationship or a bad length, gives none.

    Confidence is clamped to 0..1 (0.5 if missing); the relationship defaults to REFERS_TO.
    """
    items = F.from_json(payload, f"references array<struct<{', '.join(p.replace(' ', ':', 1) for p in ITEM.split(', ')) }>>")["references"]
    kind = lambda i: F.upper(F.coalesce(i["relationship"], F.lit("REFERS_TO")))
    sound = lambda i: F.coalesce(F.length(i["raw_text"]).between(3, 1000), F.lit(False)) & kind(i).isin(*RELATIONSHIPS)
    numbers = F.regexp_extract_all(F.col(text), F.lit(r"(\d+[A-Za-z]?)"), F.lit(1))
    plain = F.regexp_extract_all(F.col(text), F.lit(r"(\d+)"), F.lit(1))
    rows = df.withColumns({"_items": items, "_numbers": F.array_union(numbers, plain)}).where(F.forall("_items", sound))
    kept = F.filter("_items", lambda i: ~invented(F.col("_numbers"), i))
    one = rows.select(key, F.explode(kept).alias("_i"))
    return one.select(
        key, F.col("_i.raw_text").alias("raw_reference_text"), kind(F.col("_i")).alias("relationship_type"), F.nullif(F.trim("_i.target_act_title"), F.lit("")).alias("target_act_title_raw"),
        F.col("_i.target_act_number").alias("target_act_number"), F.col("_i.target_act_year").alias("target_act_year"), X.section_number(F.col("_i.target_section_number")).alias("target_section_number"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_i.confidence", F.lit(0.5)))).alias("confidence_score"), F.lit("LLM").alias("extraction_method"),
    )
