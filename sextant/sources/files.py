"""Files as tables: uploads by digest, gold judgements, extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import schemas


def valid_name(name: Column) -> Column:
    return ~name.rlike(r"[/\\]") & F.lower(name).endswith(".pdf")


def uploads(spark: SparkSession, path: str, known: DataFrame, limit: int = 50 << 20) -> DataFrame:
    """New PDF files under ``path``: name, size, SHA-256; too large, unsigned and known ones go, equal ones count once.

    Only digests are kept; contents stay in the tasks that read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= limit)
    name = F.element_at(F.split("path", "/"), -1)
    signed = F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")
    rows = files.where(signed & valid_name(name)).select("path", name.alias("source_file_name"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_sha256"))
    first = rows.groupBy("file_sha256").agg(F.min_by(F.struct("path", "source_file_name", "file_size"), "path").alias("f")).select("file_sha256", "f.*")
    return first.join(known.select("file_sha256"), "file_sha256", "left_anti")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Judgements from CSV with exactly the schema's columns; raises on other columns, grades outside 0-2 or queries with several texts."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schemas.GOLD.names:
        raise ValueError(f"columns must be {schemas.GOLD.names}")
    rows = spark.read.schema(schemas.GOLD).option("header", True).option("enforceSchema", False).csv(path)
    bad = rows.groupBy("query_id").agg(F.count_distinct("query", "query_type").alias("texts"), F.count_if(~F.coalesce(F.col("relevance_grade").isin("0", "1", "2"), F.lit(False))).alias("grades"))
    if wrong := bad.where("texts <> 1 OR grades > 0").limit(5).collect():
        raise ValueError(f"bad judgements: {wrong}")
    return rows.withColumn("relevance_grade", F.col("relevance_grade").cast("int"))


def grade_maps(rows: DataFrame) -> DataFrame:
    """Per query a map from expected section to grade."""
    return rows.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("expected_section_path", "relevance_grade"))).alias("grades"))


def consecutive_pages(pages: Column) -> Column:
    """Whether an array of pages is numbered 1, 2, 3 ..."""
    return F.forall(F.transform(pages, lambda p, k: p["page_number"] == k + 1), lambda ok: ok)
