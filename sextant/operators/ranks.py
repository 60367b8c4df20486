"""Exact order statistics without gathering the values: histograms are refined until a bin holds one value."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bins of a histogram: what a round returns to the driver for each interval in question.
BINS = 4096


def _bin(value: Column, low: float | int, high: float | int, whole: bool) -> Column:
    """The bin of a value of [low, high]; no bin's values lie above those of the next, and low and high are in different ones."""
    if whole:
        width = (high - low) // BINS + 1
        return F.call_function("div", value, F.lit(width)) if width > 1 else value
    share = (value / 2 - low / 2) / F.lit(high / 2 - low / 2)
    return F.least(F.floor(share * BINS).cast("long"), F.lit(BINS - 1))


def values_at(df: DataFrame, value: str, places: Iterable[int]) -> dict[int, float | int]:
    """The values at ``places`` (from 1; those outside have none) of the non-null, non-NaN values in ascending order.

    Every round counts the values of each interval that holds a place by ``BINS`` bins, in one
    aggregation whose groups are combined before the shuffle, and keeps each place's bin, narrowed to the values that occur in it. Integers
    take one round for each 12 bits of their range, other numbers about as many. ``df`` is read in each round and should be cheap to read twice.
    """
    whole = isinstance(df.schema[value].dataType, IntegralType)
    v = F.col(value) if whole else F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v IS NOT NULL" + ("" if whole else " AND NOT isnan(v)"))
    total, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    found: dict[int, float | int] = {}
    # Of each open interval: least and greatest value, how many values lie below it, and the places in it.
    open_ = [(low, high, 0, [p for p in set(places) if 1 <= p <= total])]
    while open_ := [x for x in open_ if x[3]]:
        for one in [x for x in open_ if x[0] == x[1]]:
            found |= dict.fromkeys(one[3], one[0])
            open_.remove(one)
        if not open_:
            break
        interval, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (a, b, _, _) in enumerate(open_):
            inside = F.col("v").between(F.lit(a), F.lit(b))
            interval, bin_ = F.when(inside, F.lit(k)).otherwise(interval), F.when(inside, _bin(F.col("v"), a, b, whole).cast("long")).otherwise(bin_)
        parts = rows.select("v", interval.alias("interval"), bin_.alias("bin")).where("interval IS NOT NULL").groupBy("interval", "bin")
        bins = sorted(parts.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: (r["interval"], r["bin"]))
        narrowed = []
        for k, (_, _, below, wanted) in enumerate(open_):
            own = [r for r in bins if r["interval"] == k]
            for r, upto in zip(own, accumulate(r["n"] for r in own), strict=True):
                upto += below
                narrowed.append((r["a"], r["b"], upto - r["n"], [p for p in wanted if upto - r["n"] < p <= upto]))
        open_ = narrowed
    return found


def nearest_rank(share: float, total: int) -> int:
    """The place of the nearest-rank percentile: the least whose share of ``total`` is not below ``share``."""
    return max(-int(-share * total // 1), 1)
