"""Stemmed full text over an inverted index that is a table: postings by lexeme, and how many rows each lexeme has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.stems import STOP_WORDS, with_stems
from sextant.operators.rows import dealt
from sextant.sources.storage import settle

#: A side of a join is broadcast if it has no more rows than this by a count.
BROADCAST_ROWS = 1_000_000
#: Bytes of text whose words one task counts, and what a text takes besides its own.
TASK_BYTES, TEXT_BYTES = 16 << 20, 64


def _tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def postings(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(lexeme, key, n): how often each lexeme occurs in the columns' texts of each row, stop words aside.

    Texts are dealt once, by key, to tasks of a fixed size, in which their words are then counted: postings are not shuffled. Each
    distinct token that a stem may change is stemmed once, and those that it does change are broadcast; to a larger vocabulary than that
    allows, counts are joined.
    """
    said = df.select(F.col(key).alias("key"), F.concat_ws(" ", *columns).alias("text"))
    words_of = lambda texts: texts.select("key", F.explode(_tokens(F.col("text"))).alias("token"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    able = words_of(said).where(F.col("token").rlike("^[a-z]{3,}$")).select("token").distinct().repartition(parts)
    stems = settle(with_stems(able), "stems").where("lexeme <> token")  # filtered as read: a filter would repeat the steps
    words = words_of(dealt(said, "key", F.octet_length("text") + TEXT_BYTES, TASK_BYTES))
    if stems.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = words.join(F.broadcast(stems), "token", "left").withColumn("lexeme", F.coalesce("lexeme", "token"))
        return named.groupBy("lexeme", "key").agg(F.count("*").alias("n"))
    counted = words.groupBy("key", "token").agg(F.count("*").alias("n"))
    return counted.join(stems, "token", "left").groupBy(F.coalesce("lexeme", "token").alias("lexeme"), "key").agg(F.sum("n").alias("n"))


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, key: str, columns: Sequence[str], path: str, buckets: int = 32) -> None:
    """Write the postings of ``df`` to ``path``, in folders by the lexeme's hash and sorted in each file, and the number of rows of each lexeme.

    A bucket of frequent lexemes is split into several files by the session's adaptive rebalancing. Null texts have no words; rows
    need a key of their own.
    """
    found = postings(df, key, columns).withColumn("bucket", _bucket(F.col("lexeme"), buckets))
    found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = df.select(key).schema[key].dataType.simpleString()
    rows = _postings(df.sparkSession, path, kind).groupBy("lexeme", "bucket").agg(F.count("*").alias("n_rows"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(f"{path}/lexemes")
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(kind).alias("key_type")).write.parquet(f"{path}/layout")


def _postings(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"lexeme string, key {key_type}, n long, bucket int").parquet(f"{path}/postings")


def query_lexemes(spark: SparkSession, query: str) -> list[str]:
    """The distinct lexemes of a query, stop words aside."""
    one = spark.range(1).select(F.explode(F.array_distinct(_tokens(F.lit(query)))).alias("token"))
    return sorted({r["lexeme"] for r in with_stems(one).collect()})


def search_index(spark: SparkSession, path: str, query: str, key: str = "id") -> DataFrame:
    """(key, n) of the rows that have every lexeme of the query, n counting all their occurrences; none if the query has only stop words.

    Only the folders of the query's lexemes are read. The rarest lexeme's rows come first, and are broadcast to
    the next one's if there are few enough by the index's own counts.
    """
    buckets, key_type = spark.read.parquet(f"{path}/layout").first()
    wanted = query_lexemes(spark, query)
    places = {r["lexeme"]: r["bucket"] for r in spark.createDataFrame([(w,) for w in wanted], "lexeme string").select("lexeme", _bucket(F.col("lexeme"), buckets).alias("bucket")).collect()}
    here = F.col("bucket").isin(*set(places.values())) & F.col("lexeme").isin(*wanted)
    rows = {r["lexeme"]: r["n_rows"] for r in spark.read.schema("lexeme string, n_rows long, bucket int").parquet(f"{path}/lexemes").where(here).collect()}
    table = _postings(spark, path, key_type)
    if not wanted or set(rows) != set(wanted):
        return table.where(F.lit(False)).select(F.col("key").alias(key), "n")

    def of(lexeme: str, name: str) -> DataFrame:
        return table.where((F.col("bucket") == places[lexeme]) & (F.col("lexeme") == lexeme)).select("key", F.col("n").alias(name))

    rarest, *rest = sorted(wanted, key=lambda w: (rows[w], w))
    found = of(rarest, "n")
    for lexeme in rest:
        held = F.broadcast(found) if rows[rarest] <= BROADCAST_ROWS else found
        found = of(lexeme, "more").join(held, "key").select("key", (F.col("n") + F.col("more")).alias("n"))
    return found.withColumnRenamed("key", key)
