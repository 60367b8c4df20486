"""Embedding backfill in batches of keys, each committed with a high-water mark, so that a run that stops can be resumed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.scoring import valid_vector
from sextant.operators import state

#: Keys from which the bounds of batches are found, at most. They only decide how even batches are.
SAMPLE = 100_000


@dataclass(frozen=True)
class Target:
    """The identity that embeddings must have."""

    provider: str
    model: str
    dimension: int


@dataclass(frozen=True)
class Counts:
    processed: int
    skipped: int
    failed: int
    remaining: int
    failed_remaining: int


MARKS = "batch int, mark string, processed long, skipped long, failed long"


def _marks(spark: SparkSession, path: str) -> list:
    try:
        return sorted(spark.read.schema(MARKS).parquet(f"{path}/marks").collect())
    except PySparkException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _bounds(keys: DataFrame, key: str, rows: int, batch_rows: int) -> list[str]:
    """Ends of about rows / batch_rows ranges of the key, in order; the last range has no end."""
    parts = -(-rows // batch_rows)
    if parts < 2:
        return []
    drawn = sorted(r[0] for r in keys.orderBy(F.xxhash64(key)).limit(min(SAMPLE, 64 * parts)).select(key).collect())
    return sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)})


def merged(sections: DataFrame, path: str, key: str = "id") -> DataFrame:
    """``sections`` with the rows of all committed batches in place of their own."""
    spark = sections.sparkSession
    done = [m["batch"] for m in _marks(spark, path)]
    if not done:
        return sections
    made = spark.read.schema(sections.schema).parquet(*(f"{path}/batch={k}" for k in done))
    return sections.join(made.select(key), key, "left_anti").select(*sections.columns).unionByName(made)


def run(sections: DataFrame, path: str, embed: Column, target: Target, source_hash: Column, key: str = "id", batch_rows: int = 1_000_000, limit: int | None = None,
        dry_run: bool = False, retry_failed: bool = False, force: bool = False, retries: int = 1, commit=None) -> Counts:
    """Embed what needs it, batch after batch in the order of the key; call again with the same ``path`` to resume.

    A batch is a range of keys above the last mark: its new rows are written to a folder of their own, and then one row that holds
    its greatest key is appended to the marks. What was written without a mark is written anew. Where
    ``embed`` raises, the batch is tried ``retries`` times, then its rows are marked FAILED and the run goes on; rows with an invalid vector
    are FAILED alone. ``limit``: rows to embed at most. A dry run only counts. ``merged`` gives the table. Keys must be distinct and not null.
    """
    spark = sections.sparkSession
    outdated = state.needs_embedding(target.provider, target.model, target.dimension, source_hash) | F.lit(force)
    open_ = F.lit(True) if retry_failed or force else F.coalesce(F.col("embedding_status") != "FAILED", F.lit(True))
    seen = _marks(spark, path)
    mark, batch = (seen[-1]["mark"], seen[-1]["batch"] + 1) if seen else (None, 0)
    above = sections.where(open_) if mark is None else sections.where(open_ & (F.col(key) > mark))
    todo = above.where(outdated)
    wanted = todo.count()
    if dry_run:
        processed = wanted if limit is None else min(limit, wanted)
        return Counts(processed, above.count() - wanted if limit is None else 0, 0, *_left(sections, path, key, target, source_hash))
    processed = skipped = failed = 0
    budget = wanted if limit is None else min(limit, wanted)
    for end in [*_bounds(todo, key, wanted, batch_rows), None]:
        if budget <= 0 and (limit is not None or not wanted):
            break
        inside = (F.lit(True) if mark is None else F.col(key) > mark) & (F.lit(True) if end is None else F.col(key) <= end)
        rows, rest = todo.where(inside), above.where(inside & ~outdated)
        n = rows.count()
        if n > budget:  # the run ends inside this batch: at its budget-th key
            end = rows.orderBy(key).limit(budget).agg(F.max(key)).first()[0]
            rows, rest, n = rows.where(F.col(key) <= end), rest.where(F.col(key) <= end), budget
        passed = rest.count()
        top = end if end is not None else above.where(inside).agg(F.max(key)).first()[0]
        if top is None:
            break
        folder = f"{path}/batch={batch}"
        _write(rows, folder, embed, target, source_hash, sections.columns, retries)
        bad = spark.read.schema(sections.schema).parquet(folder).where("embedding_status = 'FAILED'").count()
        one = spark.createDataFrame([(batch, str(top), n - bad, passed, bad)], MARKS)
        (commit or _commit)(one, path)
        processed, skipped, failed, budget, mark, batch = processed + n - bad, skipped + passed, failed + bad, budget - n, top, batch + 1
    return Counts(processed, skipped, failed, *_left(sections, path, key, target, source_hash))


def _commit(one: DataFrame, path: str) -> None:
    one.coalesce(1).write.mode("append").parquet(f"{path}/marks")


def _write(rows: DataFrame, folder: str, embed: Column, target: Target, source_hash: Column, columns: list[str], retries: int) -> None:
    def put(vector: Column) -> None:
        ok = F.coalesce(valid_vector(F.col("embedding"), target.dimension), F.lit(False))
        made = rows.withColumn("embedding", vector.cast(rows.schema["embedding"].dataType)).withColumn("_ok", ok).withColumns({
            "embedding_status": F.when(F.col("_ok"), "READY").otherwise("FAILED"), "embedding": F.when(F.col("_ok"), F.col("embedding")), "embedding_provider": F.lit(target.provider),
            "embedding_model": F.lit(target.model), "embedding_dimension": F.lit(target.dimension).cast(rows.schema["embedding_dimension"].dataType), "embedding_source_hash": source_hash,
        })
        made.select(*columns).write.mode("overwrite").parquet(folder)

    for _ in range(max(1, retries)):
        try:
            return put(embed)
        except PySparkException:
            continue
    put(F.lit(None))


def _left(sections: DataFrame, path: str, key: str, target: Target, source_hash: Column) -> tuple[int, int]:
    """How many rows still need an embedding, and how many have failed."""
    needs = state.needs_embedding(target.provider, target.model, target.dimension, source_hash)
    one = merged(sections, path, key).agg(F.count_if(needs).alias("a"), F.count_if(F.col("embedding_status") == "FAILED").alias("b")).first()
    return one["a"], one["b"]
