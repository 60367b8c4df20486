"""Joins and windows that several parts of the engine share, each on one key and with one shuffle on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.storage import settle


#: Of the weight by which rows are dealt to tasks, so much goes to one.
TASK_BYTES = 8 << 20


def dealt(rows: DataFrame, key: str, weight: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` in partitions by the key's hash, as many as the sum of their weights asks for: more rows make more tasks, not larger ones.

    Windows, groups and joins on the key keep to these partitions. Adaptive execution only merges the session's number of partitions,
    which does not grow with the input. Weights are summed in a job of its own.
    """
    total = rows.agg(F.sum(weight.cast("long"))).first()[0] or 0
    return rows.repartition(max(1, -(-total // task_bytes)), key)


def with_parent(children: DataFrame, parents: DataFrame, key: str, how: str = "inner", parent_key: str = "id", few: bool = False, **columns: str) -> DataFrame:
    """``children`` with columns of the row that ``key`` names, under new names (new=old). Parents' keys are distinct; other names may clash.

    few: children share few keys, or many have none; the parents that they name are settled first, so that few are broadcast
    and a hot key's children are not sorted in one task. The result is the same.
    """
    side = parents.select(F.col(parent_key).alias("_parent"), *(F.col(old).alias(new) for new, old in columns.items()))
    if few:
        side = settle(having(side, children.select(key).distinct(), "_parent", key), "parents")
    return children.join(side, F.col(key) == F.col("_parent"), how).drop("_parent")


def having(rows: DataFrame, others: DataFrame, key: str, other_key: str, without: bool = False) -> DataFrame:
    """The rows whose key is (``without``: is not) among the others'; a null key is not. Each once, however many others there are."""
    side = others.select(F.col(other_key).alias("_other"))
    return rows.join(side, F.col(key) == F.col("_other"), "left_anti" if without else "left_semi")


def having_or(rows: DataFrame, others: DataFrame, key: str, other_key: str, condition: Column) -> DataFrame:
    """The rows that fulfil the condition or whose key is among the others'."""
    side = others.select(F.col(other_key).alias("_other")).distinct()
    out = rows.join(side, F.col(key) == F.col("_other"), "left")
    return out.where(condition | F.col("_other").isNotNull()).drop("_other")


def unique_keys(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item) of the keys that exactly one row has."""
    return rows.groupBy(*keys).agg(F.min(item).alias(item), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def first_match(wanted: DataFrame, key: str, forms: str, found: DataFrame, form: str, item: str) -> DataFrame:
    """(key, item): for each row the item of the first of its forms, an array, that ``found`` (form, item; forms distinct) has."""
    asked = wanted.select(F.col(key), F.posexplode(forms).alias("_place", "_form"))
    met = asked.join(found.select(F.col(form).alias("_form"), F.col(item).alias("_item")), "_form")
    return met.groupBy(key).agg(F.min_by("_item", "_place").alias(item))


def next_start(rows: DataFrame, group: str, order: str, end: Column, name: str = "until") -> DataFrame:
    """Where the next row of the group starts, ``end`` for the last."""
    return rows.withColumn(name, F.coalesce(F.lead(order).over(Window.partitionBy(group).orderBy(order)), end))


def without_repeats(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Of runs of rows with an equal value, null included, the first."""
    place = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumns({"_last": F.lag(value).over(place), "_first": F.row_number().over(place) == 1})
    return marked.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_last"))).drop("_last", "_first")


def numbered(rows: DataFrame, group: str, *order: str, name: str = "sort_order") -> DataFrame:
    """Rows numbered from 0 in each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))


def text_above(lines: DataFrame, group: str, order: str, text: str, most: int = 4, name: str = "above") -> DataFrame:
    """The nearest text that is not blank among the ``most`` lines above."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(-most, -1)
    return lines.withColumn(name, F.last(F.nullif(F.trim(text), F.lit("")), ignorenulls=True).over(window))


def distinct_in_order(rows: DataFrame, group: str, order: str, value: str, name: str = "kept") -> DataFrame:
    """(group, array of its distinct non-empty values, each where it came first); values are combined before they are shuffled."""
    first = rows.where(F.col(value) != "").groupBy(group, value).agg(F.min(order).alias("_at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def latest_at(rows: DataFrame, column: str) -> DataFrame:
    """One row: the greatest value of a time column, and how many rows there are."""
    return rows.agg(F.max(column).alias("last_at"), F.count("*").alias("n"))
