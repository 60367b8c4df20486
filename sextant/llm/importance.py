"""Importance resampling towards a target: documents are drawn, without putting back, by target-likeness plus noise.

Features are runs of words, hashed to buckets. A bucket's gain is the log-ratio of its
share in the target to that in the corpus, in whole thousandths; a document's weight is the sum of its features'
gains, its score the weight plus Gumbel noise from a hash of doc_id. As scores are integers, an
exact histogram says how many documents lie above each score: suffix sums give the rank at which a
score begins, and only documents of equal score are put in order by doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded, settle
from sextant.operators.ranks import values_at

# After A-Z are lower-cased; bytes from 0x80 on belong to characters beyond ASCII, all of which are of words.
_WORDS, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20


def feature_codes(text: bytes, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """Block after block: the number of words, and crc32 of every run of 1 to ``order`` words, joined by a space, that ends in it."""
    at, before = 0, []
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        stop = gap.start() if gap else len(text)
        words = _WORDS.findall(text[at:stop].lower())
        at, codes = stop, list(map(crc32, words))
        if order > 1:
            held = before + words
            runs = list(map(crc32, held))
            for n in range(2, order + 1):
                runs = [crc32(b" " + held[i + n - 1], runs[i]) for i in range(len(held) - n + 1)]
                codes.extend(runs[max(len(before) - n + 1, 0) :])
            before = held[-(order - 1) :]
        yield len(words), np.array(codes, np.int64)


def bucket_counts(df: DataFrame, buckets: int, order: int) -> DataFrame:
    """(bucket, n) over all whole texts. Every task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, codes in feature_codes(text.as_py(), order):
                    total += np.bincount(codes % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    found = df.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int, order: int) -> np.ndarray:
    """For each bucket, the whole thousandths of the log-ratio of its smoothed shares in target and corpus (``buckets`` numbers on the driver)."""
    both = bucket_counts(docs, buckets, order).withColumnRenamed("n", "s").join(bucket_counts(target, buckets, order).withColumnRenamed("n", "t"), "bucket", "full_outer").fillna(0).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[both["bucket"]], t[both["bucket"]] = both["s"], both["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, order: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    kinds = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = features = weight = 0
                for n, codes in feature_codes(text.as_py(), order):
                    words, features, weight = words + n, features + len(codes), weight + int(gains[codes % len(gains)].sum())
                rows.append((words, features, weight))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(sums, f"doc_id {kinds}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, from a hash of ``seed`` and doc_id (null: the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: Binary digits, after the first, by which bins tell distances apart.
DIGITS = 8


def _bin(distance: Column) -> Column:
    """Bins whose width grows with the distance from the cutoff, near which most scores lie: the exponent and the next ``DIGITS`` binary digits."""
    exponent = F.greatest(F.length(F.bin(distance)) - 1 - DIGITS, F.lit(0))
    return exponent.cast("long") * (1 << DIGITS) + F.call_function("shiftright", distance, exponent)


def _start_ranks(survivors: DataFrame, cutoff: int) -> DataFrame:
    """(score, above): how many survivors have a greater score, from suffix sums over the histogram of all scores.

    The sums run inside bins of neighbouring scores, to which those of the bins above are added; the driver sees
    a number for each bin, at most 256 for each power of two.
    """
    counts = survivors.groupBy("score").agg(F.count("*").alias("n")).withColumn("distance", F.col("score") - cutoff)
    binned = counts.select("score", "n", _bin(F.col("distance")).alias("bin"))
    bins = sorted(binned.groupBy("bin").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["bin"])
    above, sums = 0, []
    for r in bins:
        sums.append((r["bin"], above))
        above += r["n"]
    higher = F.broadcast(survivors.sparkSession.createDataFrame(sums, "bin long, over long"))
    inside = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(higher, "bin").select("score", (F.col("over") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, buckets: int = 10_000, order: int = 1, seed: str = "2024") -> DataFrame:
    """Every row of ``docs`` as doc_id, n_features, weight, score, rank; rank is null if the row is not drawn.

    Of the N rows with ``least_words`` words or more the floor(share * N) of the highest scores are drawn, of equal
    scores those of smaller doc_id (null last; of rows with equal doc_id any). A null text has no words. Texts are read twice, for the counts and the
    weights; then only numbers are: they are settled, the cutoff score is found by refined histograms, and the rows
    from it on are ranked. Other columns are not read.
    """
    scored = settle(weigh(docs, bucket_gains(docs, target, buckets, order), order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    chosen, plain = F.col("n_words") >= least_words, ["doc_id", "n_features", "weight", "score"]
    able = scored.where(chosen)
    n = able.count()
    wanted = share[0] * n // share[1]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*plain, undrawn)
    cutoff = values_at(able, "score", [n - wanted + 1])[n - wanted + 1]
    survives = chosen & (F.col("score") >= cutoff)
    survivors = scored.where(survives)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = survivors.join(bounded(_start_ranks(survivors, cutoff)), "score").withColumn("rank", F.col("above") + place)
    drawn = ranked.select(*plain, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~survives).select(*plain, undrawn))
