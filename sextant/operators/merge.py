"""Keyed merge: a table of changes into a snapshot, what it may not do rejected with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import schemas
from sextant.functions import text as X
from sextant.sources.storage import settle


@dataclass(frozen=True)
class Rules:
    """What a table asks of its changes.

    checks: reason, column, and the condition under which a change with that column is refused. trimmed: texts that are stored without the
    space around them. derived: column, the column it follows, and its value. defaults: of columns that a new row does not set.
    """

    checks: tuple[tuple[str, str, Column], ...] = ()
    trimmed: tuple[str, ...] = ()
    derived: tuple[tuple[str, str, Column], ...] = ()
    defaults: tuple[tuple[str, Column], ...] = ()
    inserts: bool = False
    updates: bool = True


def _sets(column: str) -> Column:
    return F.array_contains("fields", column)


def _judged(changes: DataFrame, rules: Rules) -> DataFrame:
    tidy = changes.withColumns({c: X.strip(F.col(c)) for c in rules.trimmed if c in changes.columns})
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, column, bad in rules.checks if column in changes.columns), F.lit(None).cast("string"))
    return tidy.withColumn("_reason", reason)


def merge(snapshot: DataFrame, changes: DataFrame, key: str, order: str, rules: Rules) -> DataFrame:
    """The next snapshot: every row once, with the columns that accepted changes set.

    ``changes``: key, ``order``, ``fields`` (the names of the columns that a change sets, null included) and those columns. Of several
    changes of a row the last one that sets a column wins, as if they came one after another (equal orders: the greatest value).
    Changes of one key are combined before the one shuffle on the key; then it is a join of at most one row on either side.
    """
    columns = [c for c in snapshot.columns if c in changes.columns and c != key]
    good = _judged(changes, rules).where("_reason IS NULL")
    last = lambda c: F.max(F.when(_sets(c), F.struct(F.col(order).alias("at"), F.col(c).alias("value")))).alias(f"_{c}")
    folded = good.groupBy(F.col(key).alias("_key")).agg(*(last(c) for c in columns), F.count("*").alias("_n"))
    both = snapshot.withColumn("_old", F.lit(True)).join(folded, F.col(key) == F.col("_key"), "full_outer" if rules.inserts else "left")
    fresh, touched = F.col("_old").isNull(), F.col("_n").isNotNull()
    may = touched & (fresh if not rules.updates else F.lit(True))
    defaults = dict(rules.defaults)
    new = {c: F.when(may & F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).when(fresh, defaults.get(c, F.lit(None))).otherwise(F.col(c)).cast(snapshot.schema[c].dataType) for c in columns}
    rest = {c: F.when(fresh, value).otherwise(F.col(c)).cast(snapshot.schema[c].dataType) for c, value in rules.defaults if c in snapshot.columns and c not in columns}
    out = both.withColumns({key: F.coalesce(key, "_key"), **new, **rest})
    follows = {c: F.when(may & F.col(f"_{source}").isNotNull() & F.col(source).isNotNull(), value).otherwise(F.col(c)) for c, source, value in rules.derived if source in columns and c in snapshot.columns}
    return (out.withColumns(follows) if follows else out).select(*snapshot.columns)


def rejected(snapshot: DataFrame, changes: DataFrame, key: str, order: str, rules: Rules) -> DataFrame:
    """(key, order, reason) of every change that ``merge`` leaves out: refused by a check, not found, or there already."""
    judged = _judged(changes, rules).select(key, order, F.col("_reason").alias("reason"))
    refused, passed = judged.where("reason IS NOT NULL"), judged.where("reason IS NULL").drop("reason")
    keys = snapshot.select(key).distinct()
    parts = [] if rules.inserts else [passed.join(keys, key, "left_anti").select(key, order, F.lit("not found").alias("reason"))]
    parts += [] if rules.updates else [passed.join(keys, key, "left_semi").select(key, order, F.lit("exists").alias("reason"))]
    for p in parts:
        refused = refused.unionByName(p)
    return refused


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_table(snapshot: DataFrame, path: str, key: str, buckets: int = 32) -> None:
    """A snapshot in folders by the hash of its key, as ``merge_into`` expects it."""
    snapshot.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def merge_into(spark: SparkSession, path: str, changes: DataFrame, key: str, order: str, rules: Rules, buckets: int = 32) -> list[int]:
    """Merge changes into the table at ``path``; only the folders that hold a changed key are read, shuffled and replaced.

    The new folders are settled first, so that a job that fails while it replaces them can be repeated: the merge of the same
    changes gives the same rows. Returns the folders' numbers.
    """
    dealt = changes.withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())
    now = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    after = settle(merge(now.drop("bucket"), changes, key, order, rules).withColumn("bucket", bucket_of(key, buckets)), "merged")
    after.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    return touched


def _not_of(reason: str, column: str, domain: tuple) -> tuple[str, str, Column]:
    return reason, column, _sets(column) & ~F.col(column).isin(*domain)


def _blank(column: str) -> tuple[str, str, Column]:
    return "blank text", column, _sets(column) & (F.col(column) == "")


def section_rules() -> Rules:
    """Patches of sections: number and text stay non-blank, the search form follows the text."""
    return Rules(
        (_blank("text"), _not_of("unknown status", "verification_status", schemas.VERIFICATION)), ("text", "heading"), (("normalized_text", "text", X.search_form(F.col("text"))),)
    )


def act_rules() -> Rules:
    """Patches of acts: the search form follows a title that is not empty."""
    return Rules((_not_of("unknown status", "processing_status", schemas.PROCESSING),), (), (("normalized_title", "title", F.when(F.col("title") == "", F.col("normalized_title")).otherwise(X.search_form(F.col("title")))),))


def reference_rules(inserts: bool, user: str | None = None, now: datetime | None = None, targets: bool = False) -> Rules:
    """New references (by hand, for review unless they say otherwise) or patches of old ones; who verified them and when follows a status that is set.

    targets: changes come from ``with_valid_targets``, and those whose target does not fit are refused.
    """
    score = _sets("confidence_score") & ~F.col("confidence_score").between(0, 1)
    checks = (_blank("raw_reference_text"), _not_of("unknown type", "relationship_type", schemas.RELATIONSHIPS), _not_of("unknown status", "verification_status", schemas.VERIFICATION), ("confidence out of range", "confidence_score", score))
    defaults = (("confidence_score", F.lit(0.5)), ("verification_status", F.lit("NEEDS_REVIEW")), ("extraction_method", F.lit("MANUAL")))
    settled = F.col("verification_status").isin("VERIFIED", "REJECTED")
    derived = (("verified_by_user_id", "verification_status", F.when(settled, F.lit(user))), ("verified_at", "verification_status", F.when(settled, F.lit(now).cast("timestamp_ntz"))))
    return Rules((*checks, ("bad target", "bad_target", F.col("bad_target"))) if targets else checks, ("raw_reference_text",), derived, defaults, inserts=inserts, updates=not inserts)


def gold_rules() -> Rules:
    """New gold judgements: a grade is 0, 1 or 2; what is there stays."""
    return Rules((_not_of("unknown grade", "relevance_grade", (0, 1, 2)),), inserts=True, updates=False)


def with_valid_targets(changes: DataFrame, references: DataFrame, acts: DataFrame, sections: DataFrame, key: str = "id") -> DataFrame:
    """Add ``bad_target``: the target act or section that a reference would have does not exist, or the section is of another act.

    What a change does not set is as in the row now.
    """
    old = references.select(F.col(key).alias("_id"), F.col("target_act_id").alias("_act"), F.col("target_section_id").alias("_section"))
    both = changes.join(old, F.col(key) == F.col("_id"), "left")
    now = lambda c, was: F.nullif(F.when(_sets(c), F.col(c)).otherwise(F.col(was)), F.lit(""))
    asked = both.withColumns({"_act": now("target_act_id", "_act"), "_section": now("target_section_id", "_section")}).drop("_id")
    held = asked.join(acts.select(F.col("id").alias("_aid")).distinct(), F.col("_act") == F.col("_aid"), "left")
    held = held.join(sections.select(F.col("id").alias("_sid"), F.col("act_id").alias("_owner")), F.col("_section") == F.col("_sid"), "left")
    lost = F.col("_act").isNotNull() & F.col("_aid").isNull() | F.col("_section").isNotNull() & F.col("_sid").isNull()
    return held.withColumn("bad_target", lost | F.coalesce(F.col("_act") != F.col("_owner"), F.lit(False))).drop("_act", "_section", "_aid", "_sid", "_owner")
