"""Evaluation: set metrics and ranked-retrieval metrics over tables of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators import ranks
from sextant.sources.storage import settle


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b), 4), F.lit(0.0))


def set_metrics(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 (0 where undefined) over distinct keys, for each group in ``by``."""
    names = [*by, *keys]
    g, p = gold.select(*names).distinct().withColumn("_g", F.lit(True)), predicted.select(*names).distinct().withColumn("_p", F.lit(True))
    both = g.join(p, names, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    sums = both.groupBy(*by).agg(F.count_if(has("_g") & has("_p")).alias("tp"), F.count_if(~has("_g")).alias("fp"), F.count_if(~has("_p")).alias("fn"))
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.withColumns({n: F.coalesce(F.round(c, 4), F.lit(0.0)) for n, c in (("precision", precision), ("recall", recall), ("f1", f1))})


def segmentation_accuracy(expected: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """One row: the share of distinct expected keys that were detected; null if none are expected. The act plays no part."""
    e, d = expected.select(key).distinct(), detected.select(key).distinct()
    hit = e.join(d.withColumn("_d", F.lit(True)), key, "left")
    return hit.agg(F.round(F.try_divide(F.count("_d").cast("double"), F.count("*")), 4).alias("accuracy"))


def differences(gold: DataFrame, predicted: DataFrame, key: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Missing and extra keys, sorted, the first ``limit`` of each."""
    g, p = gold.select(key), predicted.select(key)
    return g.subtract(p).orderBy(key).limit(limit), p.subtract(g).orderBy(key).limit(limit)


def ranking_metrics(retrieved: DataFrame, grades: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query P@5 (always over 5), R@5, R@10, MRR, nDCG@10 (gain 2^grade - 1), and whether nothing was retrieved.

    retrieved: query_id, item, rank; grades: query_id, item, grade; queries: query_id. Without a
    relevant item recall is 1, MRR 0 and nDCG 1 only if nothing was retrieved.
    """
    graded = retrieved.join(grades, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = F.try_divide(F.pow(F.lit(2.0), F.col("grade")) - 1, F.log2(F.col("rank") + F.lit(1.0)))
    hit = F.col("grade") > 0
    seen = graded.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col("rank") <= 5)).alias("hit5"), F.count_if(hit & (F.col("rank") <= 10)).alias("hit10"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item"))
    ideal = grades.where("grade > 0").withColumn("rank", place).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("idcg"))
    out = queries.select("query_id").join(seen, "query_id", "left").join(ideal, "query_id", "left")
    n, rel = F.coalesce("n", F.lit(0)), F.coalesce("relevant", F.lit(0))
    share = lambda c: F.when(rel > 0, F.coalesce(c, F.lit(0)) / F.col("relevant")).otherwise(1.0)
    return out.select(
        "query_id", F.round(F.coalesce("hit5", F.lit(0)) / F.lit(5.0), 6).alias("p5"), F.round(share("hit5"), 6).alias("r5"), F.round(share("hit10"), 6).alias("r10"),
        F.round(F.when(rel > 0, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(rel > 0, F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).otherwise(F.when(n == 0, 1.0).otherwise(0.0)), 6).alias("ndcg10"),
        (n == 0).alias("zero_result"), n.cast("bigint").alias("retrieved"),
    )


def aggregate_metrics(per_query: DataFrame) -> DataFrame:
    """Means over queries, the zero-result and verified rates, the median and nearest-rank 95th percentile of latency.

    ``per_query``: as from ``ranking_metrics``, with verified (results that are) and latency_ms, which is settled: its percentiles
    come from histograms that are refined until they are exact, in no task's memory. Without latencies they are null.
    """
    times = settle(per_query.select(F.col("latency_ms").alias("ms")).where("ms IS NOT NULL"), "latencies")
    n = times.count()
    middle, late = ((n + 1) // 2, n // 2 + 1), ranks.nearest_rank(0.95, n)
    at = ranks.values_at(times, "ms", [*middle, late])
    median = (at[middle[0]] + at[middle[1]]) / 2 if n else None
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    verified = F.coalesce(F.try_divide(F.sum("verified").cast("double"), F.sum("retrieved")), F.lit(0.0))
    return per_query.agg(
        F.count("*").alias("queries"), *(mean(c) for c in ("p5", "r5", "r10", "mrr", "ndcg10")), F.round(F.avg(F.col("zero_result").cast("int")), 6).alias("zero_rate"),
        F.round(verified, 6).alias("verified_rate"), F.lit(median).cast("double").alias("median_ms"), F.lit(at.get(late)).cast(times.schema["ms"].dataType).alias("p95_ms"),
    )


def resolve_gold(gold: DataFrame, sections: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold rows with the one section that their file name and path name; and those that name none or several."""
    s = sections.join(acts.select(F.col("id").alias("act_id"), "source_file_name"), "act_id").select(F.col("source_file_name").alias("document_identifier"), F.col("section_path").alias("expected_section_path"), F.col("id").alias("section_id"))
    n = F.count("section_id").over(Window.partitionBy("query_id", "document_identifier", "expected_section_path"))
    found = gold.join(s, ["document_identifier", "expected_section_path"], "left").withColumn("_n", n)
    return found.where("_n = 1").drop("_n"), found.where("_n <> 1").select(*gold.columns, F.col("_n").alias("sections")).distinct()


def parser_comparison(texts: DataFrame, gold_spans: DataFrame) -> DataFrame:
    """Per parser and document with gold spans: characters, and how many of the spans its text contains. Texts meet each document's spans once."""
    spans = gold_spans.groupBy("id").agg(F.collect_list("span").alias("spans"))
    counted = texts.join(spans, "id").withColumn("found", F.size(F.filter("spans", lambda s: F.col("text").contains(s))).cast("long"))
    return counted.select("parser", "id", F.length("text").alias("chars"), "found", F.round(F.col("found") / F.size("spans"), 4).alias("recall"))
