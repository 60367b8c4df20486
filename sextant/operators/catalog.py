"""Catalogue and workspace roll-ups: one conditional aggregation per child table, joined once."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def tallies(df: DataFrame, key: str, column: str, domain: Sequence[str], total: str = "total") -> DataFrame:
    """Per key the number of rows, and of each value of ``domain`` (zeros included), in one pass."""
    return df.groupBy(key).agg(F.count("*").alias(total), *(F.count_if(F.col(column) == v).alias(v.lower()) for v in domain))


def reference_summary(references: DataFrame, least: float = 0.5) -> DataFrame:
    """Per relationship: how many references, how many without a target, and how many of at least that confidence."""
    counts = (F.count("*").alias("n"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.count_if(F.col("confidence") >= least).alias("confident"))
    return references.groupBy("relationship").agg(*counts)


def domain_counts(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(value, n) for every member of ``domain``, zeros included."""
    found = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    values = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return values.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def verification_summary(acts: DataFrame, sections: DataFrame, references: DataFrame) -> DataFrame:
    """Per act: sections and references in all, verified, pending, rejected, for review; references mapped and not."""
    state = lambda s: F.count_if(F.col("verification_status") == s)
    names = {"verified": "VERIFIED", "pending": "PENDING", "rejected": "REJECTED", "needs_review": "NEEDS_REVIEW"}
    s = sections.groupBy("act_id").agg(F.count("*").alias("sections"), *(state(v).alias(f"sections_{k}") for k, v in names.items()))
    is_mapped = F.coalesce("target_act_id", "target_section_id").isNotNull()
    r = references.groupBy(F.col("source_act_id").alias("act_id")).agg(
        F.count("*").alias("references"), *(state(v).alias(f"references_{k}") for k, v in names.items()), F.count_if(is_mapped).alias("mapped"), F.count_if(~is_mapped).alias("unresolved")
    )
    out = acts.select(F.col("id").alias("act_id")).join(s, "act_id", "left").join(r, "act_id", "left")
    return out.na.fill(0, [c for c in out.columns if c != "act_id"])


def browse_counts(acts: DataFrame, sections: DataFrame, references: DataFrame, updated: str | None = None) -> DataFrame:
    """Acts with their numbers of verified sections and references."""
    s = sections.where("verification_status = 'VERIFIED'").groupBy("act_id").agg(F.count("*").alias("verified_sections"))
    r = references.where("verification_status = 'VERIFIED'").groupBy(F.col("source").alias("act_id")).agg(F.count("*").alias("verified_references"))
    extra = [F.when(F.col("processing_status") == "VERIFIED", F.col(updated)).alias("last_verified_at")] if updated else []
    out = acts.join(s, acts.id == s.act_id, "left").drop("act_id").join(r, acts.id == r.act_id, "left").drop("act_id")
    return out.select("id", "title", "processing_status", *extra, F.coalesce("verified_sections", F.lit(0)).alias("verified_sections"), F.coalesce("verified_references", F.lit(0)).alias("verified_references"))


def review_queue(acts: DataFrame, references: DataFrame) -> DataFrame:
    """Acts with references for review: how many, and how many unresolved ones of any status."""
    r = references.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("verification_status") == "NEEDS_REVIEW").alias("needs_review"), F.count_if(F.col("target").isNull()).alias("unresolved"))
    return acts.join(r.where("needs_review > 0"), "id").select("id", "title", "needs_review", "unresolved")


def embedding_status(sections: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """One row: counts by status, ready ones of another identity, the latest embedding, and why semantic search is not ready."""
    ready = F.col("embedding_status") == "READY"
    same = F.coalesce(
        F.col("embedding").isNotNull() & (F.col("embedding_provider") == provider) & (F.col("embedding_model") == model) & (F.col("embedding_dimension") == dimension) & F.col("embedding_source_hash").isNotNull(),
        F.lit(False),
    )
    count = lambda s: F.count_if(F.col("embedding_status") == s).alias(s.lower())
    one = sections.agg(F.count("*").alias("total"), *(count(s) for s in ("PENDING", "READY", "FAILED", "STALE")), F.count_if(ready & ~same).alias("mismatched"))
    reasons = F.array(
        F.when(F.col("total") == 0, "no_sections"), F.when(F.col("pending") > 0, "pending"), F.when(F.col("failed") > 0, "failed"),
        F.when(F.col("stale") > 0, "stale"), F.when(F.col("mismatched") > 0, "identity_mismatch"),
    )
    named = one.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return named.withColumn("is_ready", F.size("reasons") == 0)


def saved_items(items: DataFrame, acts: DataFrame, sections: DataFrame, references: DataFrame) -> DataFrame:
    """Saved items with their act (their own, their section's, or their reference's source), a title and a status. To-one left joins."""
    a = acts.select(F.col("id").alias("_a"), F.col("title").alias("act_title"), F.col("processing_status").alias("act_status"))
    s = sections.select(F.col("id").alias("_s"), F.col("act_id").alias("s_act"), "heading", "section_number", F.col("verification_status").alias("s_status"))
    r = references.select(F.col("id").alias("_r"), F.col("source_act_id").alias("r_act"), "raw_reference_text", F.col("verification_status").alias("r_status"))
    out = items.join(s, F.col("section_id") == F.col("_s"), "left").join(r, F.col("reference_id") == F.col("_r"), "left")
    out = out.withColumn("of_act", F.coalesce("act_id", "s_act", "r_act")).join(a, F.col("of_act") == F.col("_a"), "left")
    section = F.concat_ws(" ", F.concat(F.lit("Section "), F.col("section_number")), F.col("heading"))
    title = F.when(F.col("item_type") == "REFERENCE", F.col("raw_reference_text")).when(F.col("item_type") == "SECTION", section).otherwise(F.col("act_title"))
    status = F.coalesce("r_status", "s_status", "act_status")
    return out.withColumns({"title": F.coalesce(title, F.lit("Saved item")), "status": status}).drop("_a", "_s", "_r", "s_act", "r_act", "s_status", "r_status", "act_status")


def history_links(items: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """History items with title and link."""
    a, s = acts.select(F.col("id").alias("act_id"), "title"), sections.select(F.col("id").alias("section_id"), "heading")
    href = F.when(F.col("section_id").isNotNull(), F.concat(F.lit("/sections/"), F.col("section_id"))).otherwise(F.concat(F.lit("/acts/"), F.col("act_id")))
    return items.join(a, "act_id", "left").join(s, "section_id", "left").withColumn("href", href)


def text_filter(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Rows whose columns together contain the text, case aside."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.strip().lower()))


def facets(acts: DataFrame) -> DataFrame:
    """(facet, value): years newest first and categories, each once."""
    years = acts.where("year IS NOT NULL").select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"))
    kinds = acts.where("category IS NOT NULL").select(F.lit("category").alias("facet"), F.col("category").alias("value"))
    return years.unionAll(kinds).distinct()


def newest(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), key).limit(n)


def adjacent(sections: DataFrame, act: str = "act_id", order: str = "sort_order") -> DataFrame:
    w = Window.partitionBy(act).orderBy(order)
    return sections.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w)})


@F.pandas_udf(ArrayType(StringType()))
def _messages(values: pd.Series) -> pd.Series:
    def walk(value: object, inside: bool) -> Iterator[str]:
        if isinstance(value, dict):
            for key, part in sorted(value.items()):
                yield from walk(part, inside or key in ("warnings", "errors"))
        elif isinstance(value, list):
            for part in value:
                yield from walk(part, inside)
        elif inside and isinstance(value, str):
            yield value

    return values.map(lambda v: list(dict.fromkeys(walk(json.loads(v), False))) if v else [])


def warning_messages(jobs: DataFrame, column: str = "summary_json", limit: int = 10) -> DataFrame:
    """Distinct strings under any ``warnings`` or ``errors`` key at any depth, in the order of keys and places, the first ``limit``."""
    return jobs.select("id", F.explode(F.slice(_messages(column), 1, limit)).alias("message"))


def display(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
