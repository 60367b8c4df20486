"""The best of many candidates by a similarity that is dear: cheap bounds decide which pairs are worth it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.sources.storage import settle

#: From this length of the right text on, the ratio leaves frequent characters out, and containment no longer fixes it.
LONG = 200
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _over(common: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * common, F.length(a) + F.length(b)), F.lit(1.0))


def by_length(a: Column, b: Column) -> Column:
    """A bound of the ratio: the shorter text matches in whole."""
    return _over(F.least(F.length(a), F.length(b)), a, b)


def by_letters(a: Column, b: Column) -> Column:
    """A closer one: as many of each letter match as both have; all others together count as one letter."""
    in_ = lambda t, letter: F.length(t) - F.length(F.replace(t, letter, F.lit("")))
    same = F.aggregate(F.transform(F.split(F.lit(LETTERS), ""), lambda x: F.least(in_(a, x), in_(b, x))), F.lit(0), lambda x, y: x + y)
    others = F.least(*(F.length(F.translate(t, LETTERS, "")) for t in (a, b)))
    return _over(same + others, a, b)


def known_ratio(a: Column, b: Column) -> Column:
    """The ratio without a comparison, where one text holds the other; else null."""
    return F.when((F.length(b) < LONG) & (b.contains(a) | a.contains(b)), by_length(a, b))


def best_match(pairs: DataFrame, group: Sequence[str], left: str, right: str, item: str, least: float = 0.5, margin: float = 0.15, copies: str | None = None,
               score=X.fuzzy_ratio, bounds=(by_length, by_letters), known=known_ratio) -> DataFrame:
    """(group, item, score, second, sure): of each group's pairs the best, the least item of equals, if its score is ``least`` or more.

    second: the next score if it is closer than ``margin``, else null; sure says that there is none. ``copies`` says how many candidates a
    row stands for. Only pairs that can win or spoil the margin are scored: those whose upper bounds, the cheap one
    first, come within the margin of what the group surely reaches. That is the best known score and, of the
    unknown ones, the score of the pair with the highest bound, which is found first. Groups are reduced by aggregation, so a large one is not gathered.
    Pairs within the cheap bound are settled.
    """
    keys, a, b = list(group), F.col(left), F.col(right)
    cheap, close = bounds
    rows = pairs.select(*keys, a.alias("_a"), b.alias("_b"), F.col(item).alias("_item"), (F.col(copies) if copies else F.lit(1)).alias("_copies"))
    a, b = F.col("_a"), F.col("_b")
    rows = rows.where(a.isNotNull() & b.isNotNull()).withColumn("_known", known(a, b).cast("double"))

    def within(df: DataFrame, floor: DataFrame, bound: Column) -> DataFrame:
        reach = F.greatest(F.coalesce("_floor", F.lit(0.0)), F.lit(least))
        return df.join(floor, _same(df, floor, keys), "left").where(F.coalesce("_known", bound) > reach - margin - 1e-6).select(*(df[k] for k in keys), *(c for c in df.columns if c not in keys))

    def best(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(column).alias("_floor"))

    near = within(rows, best(rows.where("_known IS NOT NULL"), "_known"), cheap(a, b))
    near = settle(near.withColumn("_bound", F.coalesce("_known", close(a, b))), "pairs")
    scored = near.where("_known IS NOT NULL").withColumn("_score", F.col("_known"))
    unknown = near.where("_known IS NULL")
    if not unknown.isEmpty():
        top = unknown.groupBy(*keys).agg(F.max_by(F.struct("_a", "_b"), F.struct("_bound", "_item")).alias("_top"))
        first = top.select(*(F.col(k).alias(f"_{k}") for k in keys), score(F.col("_top._a"), F.col("_top._b")).alias("_floor"))
        floor = first.unionByName(best(scored, "_score")).groupBy(*(f"_{k}" for k in keys)).agg(F.max("_floor").alias("_floor"))
        scored = scored.unionByName(within(unknown, floor, F.col("_bound")).withColumn("_score", score(a, b)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_item"))
    two = scored.select(*keys, "_item", "_copies", "_score", place.alias("_place")).where("_place <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("_place") == 1, F.struct("_item", "_score", "_copies"))).alias("_best"), F.max(F.when(F.col("_place") == 2, F.col("_score"))).alias("_next")
    )
    second = F.when(F.col("_best._copies") > 1, F.col("_best._score")).otherwise(F.col("_next"))
    second = F.when(F.col("_best._score") - second < margin, second)
    out = two.select(*keys, F.col("_best._item").alias(item), F.col("_best._score").alias("score"), second.alias("second"))
    return out.where(F.col("score") >= least).withColumn("sure", F.col("second").isNull())


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def _of_longer(common: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(common, F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def by_edits(a: Column, b: Column) -> Column:
    """Similarity by edit distance: 1 less the distance over the longer length."""
    return 1.0 - F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def edits_by_length(a: Column, b: Column) -> Column:
    return _of_longer(F.least(F.length(a), F.length(b)), a, b)


def edits_by_letters(a: Column, b: Column) -> Column:
    """At least as many edits as the longer text has letters that the other lacks."""
    return _of_longer(by_letters(a, b) * (F.length(a) + F.length(b)) / 2.0, a, b)


EDITS = {"score": by_edits, "bounds": (edits_by_length, edits_by_letters), "known": lambda a, b: F.when(a == b, F.lit(1.0))}
