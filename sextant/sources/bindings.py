"""The engine's tables as views over the star-schema test tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as acts; the label gives the processing status."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "VERIFIED").when(F.col("quality") == 0, "PROCESSED").otherwise("UPLOADED")
    return d.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), (F.col("doc_id") % 50).cast("string").alias("act_number"), (1978 + F.col("doc_id") % 48).cast("int").alias("year"),
        F.col("source").alias("category"), "lang", F.col("text").alias("raw_text"), status.alias("processing_status"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    turn = (F.col("conv_id") + F.col("turn")) % 4
    status = F.when(turn == 0, "VERIFIED").when(turn == 1, "PENDING").when(turn == 2, "NEEDS_REVIEW").otherwise("REJECTED")
    return c.select(F.col("conv_id").alias("act_id"), F.col("turn").alias("sort_order"), F.col("role").alias("heading"), "text", status.alias("verification_status"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "AMENDS").when(F.col("l_returnflag") == "N", "REFERS_TO").otherwise("REPEALS")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("source"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 10).alias("target"), kind.alias("relationship"),
        F.when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("NEEDS_REVIEW").alias("verification_status"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_shipdate").alias("created_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("section_id"), F.col("label").alias("act_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), F.col("ts").alias("viewed_at"), F.col("event_type").alias("item_type"))


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute texts, one for each part: cover, title, preamble, parts, one to four sections with and without marginal headings, a schedule."""
    p = read(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size") % 4 + 1
    only = lambda condition, *parts: F.when(condition, F.concat(*(F.lit(x) if isinstance(x, str) and x[:1] != "$" else F.col(x[1:]) if isinstance(x, str) else x for x in parts))).otherwise("")
    year = F.col("p_partkey") % 40 + 1980
    text = F.concat(
        F.lit("PARLIAMENT OF THE DEMOCRATIC SOCIALIST REPUBLIC\n"), F.upper("p_name"), F.lit(" ACT, No. "), "p_size", F.lit(" of "), year, F.lit("\n[Certified on 3rd March, "), year, F.lit("]\n"),
        F.lit("Be it enacted as follows: \n\n"), only(k % 2 == 0, "PART I\nGENERAL\n\n"), F.lit("Short title\n1. This Act may be cited as the "), "p_name", F.lit(" Act.\n"),
        only(n >= 2, "2. Powers; and more.\n\n  Text of ", "$p_brand", ".\n\n"),
        only(n >= 3, "Amendment of section ", F.col("p_size"), " of the principal enactment\n3. Section ", F.col("p_size"), " of the ", F.initcap("p_name"), " Act, No. 7 of ", year, " is hereby amended.\n"),
        only(k % 3 == 0, "PART II\n"), only(n >= 4, "4.\nPowers of ", "$p_brand", "\nas in section 5.\n"), only(k % 5 == 0, "\nFIRST SCHEDULE\n1. Form of ", "$p_type", "\n"),
    )
    return p.select(k.alias("id"), text.alias("raw_text"), F.concat(F.lit("act_"), k, F.lit(".pdf")).alias("source_file_name"))
