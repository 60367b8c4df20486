"""State as pure snapshot transforms: a frame in, the next frame out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.scoring import valid_vector

LOCKED = ("VERIFIED", "REJECTED")


def latest(events: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last event of each identity: a pre-aggregated maximum, no sort."""
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col(tie))).alias("_last")
    return events.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def expire_jobs(jobs: DataFrame, now: datetime, minutes: int = 30) -> DataFrame:
    """RUNNING jobs created more than ``minutes`` before ``now`` become FAILED."""
    old = (F.col("status") == "RUNNING") & (F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumns({"expired": old, "status": F.when(old, "FAILED").otherwise(F.col("status"))})


def fail_acts(acts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Acts that were being processed by an expired job become FAILED."""
    gone = jobs.where("expired").select(F.col("act_id").alias("_gone")).distinct()
    out = acts.join(gone, acts.id == gone._gone, "left")
    hit = F.col("_gone").isNotNull() & (F.col("processing_status") == "PROCESSING")
    return out.withColumn("processing_status", F.when(hit, "FAILED").otherwise(F.col("processing_status"))).drop("_gone")


def decide(df: DataFrame, key: Column, status: str, user: str | None = None, now: datetime | None = None) -> DataFrame:
    """Verify or reject the rows where ``key`` holds; references also record who and when."""
    changes = {"verification_status": F.when(key, status).otherwise(F.col("verification_status"))}
    if "verified_by_user_id" in df.columns:
        changes["verified_by_user_id"] = F.when(key, F.lit(user)).otherwise(F.col("verified_by_user_id"))
        changes["verified_at"] = F.when(key, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("verified_at"))
    return df.withColumns(changes)


def link(df: DataFrame, key: Column, act: str | None, section: str | None, user: str | None = None, now: datetime | None = None) -> DataFrame:
    """Set a reference's target and verify it; without a target it is for review and its verifier is cleared."""
    out = df.withColumns({"target_act_id": F.when(key, F.lit(act)).otherwise(F.col("target_act_id")), "target_section_id": F.when(key, F.lit(section)).otherwise(F.col("target_section_id"))})
    mapped = act is not None or section is not None
    return decide(out, key, "VERIFIED" if mapped else "NEEDS_REVIEW", user if mapped else None, now if mapped else None)


def invalid_targets(references: DataFrame, sections: DataFrame) -> DataFrame:
    """References whose target section is not of their target act."""
    s = sections.select(F.col("id").alias("target_section_id"), F.col("act_id").alias("target_act_id"))
    return references.where("target_section_id IS NOT NULL").join(s, ["target_section_id", "target_act_id"], "left_anti")


def reprocess_sections(sections: DataFrame, drafts: DataFrame, references: DataFrame) -> DataFrame:
    """Locked sections and those that hold a locked reference stay; new drafts replace the rest, but for keys that stay."""
    holding = references.where(F.col("verification_status").isin(*LOCKED)).select(F.col("source_section_id").alias("id")).distinct()
    held = sections.join(holding.withColumn("_held", F.lit(True)), "id", "left")
    stay = held.where(F.col("verification_status").isin(*LOCKED) | F.col("_held").isNotNull()).drop("_held")
    fresh = drafts.join(stay.select("act_id", "section_number", "section_path"), ["act_id", "section_number", "section_path"], "left_anti")
    return stay.unionByName(fresh, allowMissingColumns=True)


def cap_unmapped(references: DataFrame) -> DataFrame:
    """Unmapped references of a model have confidence 0.5 at most and are for review."""
    hit = (F.col("extraction_method") == "LLM") & F.coalesce("target_act_id", "target_section_id").isNull()
    return references.withColumns({"confidence_score": F.when(hit, F.least("confidence_score", F.lit(0.5))).otherwise(F.col("confidence_score")), "verification_status": F.when(hit, "NEEDS_REVIEW").otherwise(F.col("verification_status"))})


def needs_embedding(provider: str, model: str, dimension: int, source_hash: Column) -> Column:
    current = (F.col("embedding_status") == "READY") & (F.col("embedding_provider") == provider) & (F.col("embedding_model") == model) & (F.col("embedding_dimension") == dimension) & (F.col("embedding_source_hash") == source_hash)
    return ~F.coalesce(current, F.lit(False))


def mark_stale(sections: DataFrame, provider: str, model: str, dimension: int, source_hash: Column) -> DataFrame:
    old = (F.col("embedding_status") == "READY") & needs_embedding(provider, model, dimension, source_hash)
    return sections.withColumn("embedding_status", F.when(old, "STALE").otherwise(F.col("embedding_status")))


def backfill(sections: DataFrame, embed: Column, provider: str, model: str, dimension: int, source_hash: Column, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """The next snapshot with missing or outdated vectors made by ``embed`` (a column, such as a pandas UDF of the text)."""
    wanted = needs_embedding(provider, model, dimension, source_hash) | F.lit(force)
    if not (retry_failed or force):
        wanted = wanted & F.coalesce(F.col("embedding_status") != "FAILED", F.lit(True))
    todo = sections.where(wanted)
    made = todo.withColumn("embedding", embed).withColumn("_ok", F.coalesce(valid_vector(F.col("embedding"), dimension), F.lit(False)))
    made = made.withColumns({
        "embedding_status": F.when(F.col("_ok"), "READY").otherwise("FAILED"), "embedding": F.when(F.col("_ok"), F.col("embedding")),
        "embedding_provider": F.lit(provider), "embedding_model": F.lit(model), "embedding_dimension": F.lit(dimension), "embedding_source_hash": source_hash,
    }).drop("_ok")
    return sections.where(~wanted).unionByName(made.select(*sections.columns))


def delete_guards(acts: DataFrame, references: DataFrame, sections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per act: active_jobs, incoming (references of other acts that target it or one of its sections, each once), and deletable.

    Counts are combined before they are shuffled; each act is joined to two rows at most.
    """
    owners = sections.select(F.col("id").alias("_section"), F.col("act_id").alias("_owner"))
    held = references.join(owners, F.col("target_section_id") == F.col("_section"), "left")
    targets = F.array_distinct(F.array_compact(F.array("target_act_id", "_owner")))
    hits = held.select("source_act_id", F.explode(targets).alias("_target")).where(~F.col("source_act_id").eqNullSafe(F.col("_target")))
    incoming = hits.groupBy("_target").agg(F.count("*").alias("incoming"))
    active = jobs.where(F.col("status").isin("QUEUED", "RUNNING")).groupBy(F.col("act_id").alias("_busy")).agg(F.count("*").alias("active_jobs"))
    both = acts.join(incoming, F.col("id") == F.col("_target"), "left").join(active, F.col("id") == F.col("_busy"), "left")
    out = both.select("id", F.coalesce("active_jobs", F.lit(0)).alias("active_jobs"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
    return out.withColumn("deletable", (F.col("active_jobs") == 0) & (F.col("incoming") == 0))


def delete_act(act_id: str, tables: dict[str, tuple[DataFrame, str]], references: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Every table without the act's rows; refused while a job runs or other acts refer to it."""
    if not jobs.where((F.col("act_id") == act_id) & F.col("status").isin("QUEUED", "RUNNING")).isEmpty():
        raise ValueError("a job of this act is active")
    if not references.where((F.col("target_act_id") == act_id) & (F.col("source_act_id") != act_id)).isEmpty():
        raise ValueError("other acts refer to this act")
    return {name: df.where(~F.col(column).eqNullSafe(F.lit(act_id))) for name, (df, column) in tables.items()}


def save_items(saved: DataFrame, new: DataFrame) -> DataFrame:
    """New saved items whose identity (nulls equal) is not there yet, each once."""
    keys = ["user_id", "item_type", "act_id", "section_id", "reference_id"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}"))
    fresh = new.dropDuplicates(keys).alias("n").join(saved.alias("s"), same, "left_anti")
    return saved.unionByName(fresh, allowMissingColumns=True)


def advance_job(jobs: DataFrame, key: Column, step: str, percent: int, now: datetime) -> DataFrame:
    """QUEUED -> RUNNING -> COMPLETED by progress."""
    done = percent >= 100
    return jobs.withColumns({
        "status": F.when(key, "COMPLETED" if done else "RUNNING").otherwise(F.col("status")), "current_step": F.when(key, step).otherwise(F.col("current_step")),
        "progress_percent": F.when(key, percent).otherwise(F.col("progress_percent")), "started_at": F.when(key, F.coalesce("started_at", F.lit(now).cast("timestamp_ntz"))).otherwise(F.col("started_at")),
        "completed_at": F.when(key & F.lit(done), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("completed_at")),
    })


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")
