"""What several operators of this subpackage share: tables, shared storage, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to pure ASCII, and far faster than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        holder = spark.sparkContext
        root = getattr(holder, "_sextant_shared", None)
        if not root:
            root = holder._sextant_shared = tempfile.mkdtemp(prefix="checkpoints-sextant-")
    return root.rstrip("/")


#: Deletes the shuffle files of a query as soon as it is done.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For whole texts, or sets of their shingles: rows handed to Python together hold about 4 MB instead of being 10,000 of any size, and 512 rows are read together.
WIDE = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
_MADE: list[list[DataFrame]] = []


@contextmanager
def having(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` meanwhile, then those from before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def settle(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans then start from files that survive lost executors, and are not computed twice; the shuffles
    that led to them go when they are written. wide: rows hold whole texts or sets on their way (see ``WIDE``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sextant-{name}-{uuid.uuid4().hex}"
    with having(spark, {CLEAN_UP: "true"} | (WIDE if wide else {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sextant_path = path
    for made in _MADE:
        made.append(out)
    return out


@contextmanager
def settling() -> Iterator[list[DataFrame]]:
    """The list of all frames that are settled meanwhile, for a caller that drops them when its own result is settled."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def drop(settled: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more."""
    jvm, conf = settled.sparkSession._jvm, settled.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(settled._sextant_path)
    path.getFileSystem(conf).delete(path, True)


def group_count(df: DataFrame, size: Column, target: int) -> int:
    """How many groups of about ``target`` units ``df`` makes, at least one for each shuffle partition."""
    total = df.agg(F.sum(size.cast("double"))).first()[0] or 0
    return max(int(total // target) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Ranges at most, rows looked at for each to find its bounds (in all, ``LEAST_PROBES`` at least), and code points of a text that bounds tell apart.
RANGES, PROBES, PREFIX = 32_768, 64, 32
LEAST_PROBES = 50_000


def order_buckets(df: DataFrame, key: str, text: str, target: int, name: str = "bucket") -> tuple[DataFrame, int]:
    """``df`` with ``name``, the number of a range in the order of (``key``, ``text``), and how many ranges there are.

    key holds longs (null counts as least), text strings. Ranges hold about ``target`` bytes of
    text, more beyond ``RANGES`` of them. As in Spark's range partitioning only their bounds come from a random
    sample, so it decides how even they are, never what they hold; here the bounds are known
    on the driver and the same in every job. A key with very many rows is split by the start of its texts.
    """
    rows, total = df.agg(F.count("*"), F.sum(F.octet_length(text).cast("double"))).first()
    count = min(max(int((total or 0) // target) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), RANGES)
    least = np.iinfo(np.int64).min
    place = [F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("key"), F.coalesce(F.substring(text, 1, PREFIX), F.lit("")).alias("prefix")]
    drawn = df.select(*place, (F.coalesce(F.octet_length(text), F.lit(0)) + 16).alias("size"))
    drawn = (drawn.sample(min(1.0, max(PROBES * count, LEAST_PROBES) / rows), 1) if rows else drawn).toPandas().sort_values(["key", "prefix"])
    filled = drawn["size"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(filled, filled[-1] / count * np.arange(1, count))) if len(filled) else np.zeros(0, int)
    at = at[at < len(filled)]
    keys, prefixes = drawn["key"].to_numpy(np.int64)[at], drawn["prefix"].tolist()
    prefixes = [prefixes[k] for k in at.tolist()]

    @F.pandas_udf("int")
    def bucket(own: pd.Series, start: pd.Series) -> pd.Series:
        """How many bounds are not above (key, start of text)."""
        own = own.to_numpy(np.int64)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for k in np.flatnonzero(low < high).tolist():
            high[k] = bisect_right(prefixes, start[k], low[k], high[k])
        return pd.Series(high.astype(np.int32))

    return df.withColumn(name, bucket(*place)), count


def by_bucket(df: DataFrame, count: int, *order: Column, name: str = "bucket") -> DataFrame:
    """One partition for each bucket, sorted."""
    return df.repartitionById(count, F.col(name)).sortWithinPartitions(name, *order)


def runs_at(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``flat`` holds runs of ``sizes``, one after another; those numbered ``at``, in that order."""
    own = sizes[at]
    first = np.cumsum(own) - own
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - first, own) + np.arange(int(own.sum()))]


#: Tables that are joined by broadcast have this many rows at most; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small enough (counted first; ``df`` should be cheap to read twice)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def in_fold(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part`` modulo ``parts``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
