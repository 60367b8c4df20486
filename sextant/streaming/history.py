"""Optional streaming forms of the state operators; the batch forms are in ``sextant.operators.state``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_views(events: DataFrame, keys: list[str], order: str = "viewed_at") -> DataFrame:
    """The last view of each identity, for update or complete mode: the state is one row for each identity."""
    return events.groupBy(*keys).agg(F.max(order).alias(order), F.count("*").alias("views"))


def distinct_saves(events: DataFrame, keys: list[str], at: str = "created_at", late: str = "1 day") -> DataFrame:
    """Saved items once each, with state kept for ``late`` only."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind; late rows are taken until the watermark passes."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there and stop; ``name`` becomes an in-memory table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
