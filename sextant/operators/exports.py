"""Exports: CSV and Markdown lines, evaluation files, canonical JSON artifacts with their digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import csv_safe

DISCLAIMER = "For information only; not legal advice."


def csv_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as safe cells."""
    return df.select(*(csv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV files with a header. One file per partition: a single file is the reader's choice of coalesce, not ours."""
    csv_rows(df, columns).write.option("header", True).option("quoteAll", True).csv(path)


def markdown_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): each row as a table row; bars escaped, line ends blanked."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def artifact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``payload`` (JSON, keys in order, no blanks) and its SHA-256."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.withColumn("payload", body).withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256))


def write_artifacts(df: DataFrame, path: str) -> DataFrame:
    """Write artifacts, read them back, and return those whose digest no longer fits."""
    df.select("payload", "sha256").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("sha256"))


def artifact_view(df: DataFrame, schema: str) -> DataFrame:
    """Artifacts parsed, with flags: digest intact, JSON of the schema."""
    parsed = F.from_json("payload", schema)
    return df.withColumns({"parsed": parsed, "intact": F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256"), "valid": parsed.isNotNull()})


def pointers(acts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per act its distinct artifact keys, its own first, then its jobs' in order."""
    own = F.collect_list(F.struct("created_at", F.get_json_object("summary_json", "$.artifact_key").alias("key")))
    of_jobs = jobs.groupBy(F.col("act_id").alias("id")).agg(F.transform(F.array_sort(own), lambda x: x["key"]).alias("keys"))
    keys = F.filter(F.concat(F.array("extraction_artifact_key"), F.coalesce("keys", F.array().cast("array<string>"))), lambda k: k.isNotNull())
    return acts.join(of_jobs, "id", "left").select("id", F.array_distinct(keys).alias("keys"))


def write_evaluation(metrics: DataFrame, path: str) -> None:
    """JSON lines; refuses to overwrite."""
    metrics.write.mode("errorifexists").json(path)


def metric_lines(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    return metrics.select(F.concat_ws(" | ", *(F.format_string("%.4f", F.col(c).cast("double")) for c in columns)).alias("line"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
