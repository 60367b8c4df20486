"""Keyed merges and batch backfill against plain sequential versions."""

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sextant.operators import merge
from sextant.plans import backfill

SECTIONS = "id string, heading string, text string, normalized_text string, verification_status string"
CHANGES = "id string, n int, fields array<string>, heading string, text string, verification_status string"


def sections():
    return [(f"s{k}", f"h{k}", f"Text {k}", f"text {k}", "PENDING") for k in range(30)] + [(None, "null key", "T", "t", "PENDING")]


def changes(rng, n=200):
    out = []
    for k in range(n):
        fields = rng.sample(["heading", "text", "verification_status"], rng.randint(0, 3))
        out.append((rng.choice([f"s{rng.randint(0, 34)}", "s1"]), k, fields, rng.choice([" new head ", None, ""]), rng.choice(["Some  New-Text", "  ", None]), rng.choice(["VERIFIED", "REJECTED", "LOST"])))
    return out


def sequential(rows, patches):
    table, refused = {r[0]: list(r) for r in rows}, []
    for i, n, fields, heading, text, status in sorted(patches, key=lambda c: c[1]):
        heading, text = heading and heading.strip(), text and text.strip()
        if "text" in fields and text == "":
            refused.append((i, n, "blank text"))
        elif "verification_status" in fields and status == "LOST":
            refused.append((i, n, "unknown status"))
        elif i not in table:
            refused.append((i, n, "not found"))
        else:
            row = table[i]
            row[1] = heading if "heading" in fields else row[1]
            if "text" in fields:
                row[2], row[3] = text, row[3] if text is None else " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())
            row[4] = status if "verification_status" in fields else row[4]
    return sorted(map(tuple, table.values()), key=str), sorted(refused)


@pytest.mark.parametrize("seed", range(3))
def test_patches_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    patches = [c for c in changes(rng) if not (c[4] is None and "text" in c[2])]
    snapshot = spark.createDataFrame(sections(), SECTIONS)
    df = spark.createDataFrame(patches, CHANGES).repartition(5).withColumn("_n", F.lit("clash")).drop("_n")
    want, refused = sequential(sections(), patches)
    assert sorted(map(tuple, merge.merge(snapshot, df, "id", "n", merge.section_rules()).collect()), key=str) == want
    assert sorted(map(tuple, merge.rejected(snapshot, df, "id", "n", merge.section_rules()).collect())) == refused


def test_null_is_set_and_the_form_stays(spark):
    snapshot = spark.createDataFrame(sections()[:1], SECTIONS)
    df = spark.createDataFrame([("s0", 1, ["text", "heading"], None, None, None)], CHANGES)
    assert tuple(merge.merge(snapshot, df, "id", "n", merge.section_rules()).first()) == ("s0", None, None, "text 0", "PENDING")
    assert merge.merge(snapshot, df.limit(0), "id", "n", merge.section_rules()).collect() == snapshot.collect()
    assert merge.merge(snapshot.limit(0), df, "id", "n", merge.section_rules()).collect() == []


REFS = "id string, raw_reference_text string, relationship_type string, target_act_id string, target_section_id string, confidence_score double, extraction_method string, verification_status string, verified_by_user_id string, verified_at timestamp_ntz"
REF_CHANGES = "id string, n int, fields array<string>, raw_reference_text string, relationship_type string, target_act_id string, target_section_id string, confidence_score double, verification_status string"


def test_references_are_created_and_patched(spark):
    now = datetime(2024, 1, 2)
    refs = spark.createDataFrame([("r1", "sec 1", "AMENDS", "a1", "x1", 0.9, "REGEX", "PENDING", None, None), ("r2", "sec 2", "AMENDS", None, None, 0.2, "REGEX", "VERIFIED", "u0", now)], REFS)
    acts, secs = spark.createDataFrame([("a1",), ("a2",)], "id string"), spark.createDataFrame([("x1", "a1"), ("x2", "a2")], "id string, act_id string")
    c = lambda i, n, fields, raw=None, kind=None, act=None, sec=None, score=None, status=None: (i, n, fields, raw, kind, act, sec, score, status)
    patches = [c("r1", 1, ["target_act_id"], act="a2"), c("r1", 2, ["verification_status", "confidence_score"], status="VERIFIED", score=0.4), c("r2", 3, ["target_section_id"], sec="x2"), c("r2", 4, ["verification_status"], status="NEEDS_REVIEW"),
               c("r2", 5, ["confidence_score"], score=1.5), c("r9", 6, ["target_act_id"], act="a1"), c("r2", 7, ["target_act_id"], act="gone"), c("r2", 8, ["relationship_type"], kind="HATES")]
    df = merge.with_valid_targets(spark.createDataFrame(patches, REF_CHANGES), refs, acts, secs)
    rules = merge.reference_rules(False, "u1", now, targets=True)
    got = {r["id"]: r for r in merge.merge(refs, df, "id", "n", rules).collect()}
    assert (got["r1"]["target_act_id"], got["r1"]["verification_status"], got["r1"]["verified_by_user_id"], got["r1"]["verified_at"], got["r1"]["confidence_score"]) == ("a1", "VERIFIED", "u1", now, 0.4)
    assert (got["r2"]["target_section_id"], got["r2"]["verification_status"], got["r2"]["verified_by_user_id"], got["r2"]["verified_at"]) == ("x2", "NEEDS_REVIEW", None, None)
    assert {(r["n"], r["reason"]) for r in merge.rejected(refs, df, "id", "n", rules).collect()} == {(1, "bad target"), (5, "confidence out of range"), (6, "not found"), (7, "bad target"), (8, "unknown type")}
    made = [c("r3", 1, ["raw_reference_text", "relationship_type"], " raw ", "ADDS"), c("r1", 2, ["raw_reference_text"], "no"), c("r4", 3, ["raw_reference_text"], "  ")]
    new = spark.createDataFrame(made, REF_CHANGES)
    got = {r["id"]: r for r in merge.merge(refs, new, "id", "n", merge.reference_rules(True)).collect()}
    assert (got["r3"]["raw_reference_text"], got["r3"]["confidence_score"], got["r3"]["extraction_method"], got["r3"]["verification_status"]) == ("raw", 0.5, "MANUAL", "NEEDS_REVIEW")
    assert set(got) == {"r1", "r2", "r3"} and got["r1"]["raw_reference_text"] == "sec 1"
    assert {(r["n"], r["reason"]) for r in merge.rejected(refs, new, "id", "n", merge.reference_rules(True)).collect()} == {(2, "exists"), (3, "blank text")}


def test_only_touched_folders_are_replaced(spark, tmp_path):
    path = str(tmp_path / "table")
    merge.write_table(spark.createDataFrame(sections(), SECTIONS), path, "id", 8)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    df = spark.createDataFrame([("s3", 1, ["heading"], "new", None, None), ("s99", 2, ["heading"], "x", None, None)], CHANGES)
    touched = merge.merge_into(spark, path, df, "id", "n", merge.section_rules(), 8)
    after = files()
    assert {int(p.parent.name.split("=")[1]) for p in set(before) - set(after)} <= set(touched) and len(touched) <= 2
    assert all(after[p] == t for p, t in before.items() if int(p.parent.name.split("=")[1]) not in touched)
    assert {r["id"]: r["heading"] for r in spark.read.parquet(path).collect()} == {r[0]: "new" if r[0] == "s3" else r[1] for r in sections()}
    assert merge.merge_into(spark, path, df.limit(0), "id", "n", merge.section_rules(), 8) == []


# --- backfill ---

ROWS = "id string, text string, embedding array<float>, embedding_status string, embedding_provider string, embedding_model string, embedding_dimension int, embedding_source_hash string"
TARGET = backfill.Target("p", "m", 1)


@F.pandas_udf(ArrayType(FloatType()))
def embed(text: pd.Series) -> pd.Series:
    if any(t == "poison" for t in text):
        raise ValueError("poison")
    return text.map(lambda t: [float("nan")] if t == "bad" else [float(len(t))])


def rows(poison=False):
    out = []
    for k in range(40):
        text = "bad" if k == 13 else "poison" if poison and k == 22 else "t" * (k + 1)
        status = ["READY", "PENDING", "STALE", "FAILED"][k % 4]
        out.append((f"{k:03}", text, [0.5] if status == "READY" else None, status, "p", "m", 1, f"hash-{text}" if status == "READY" and k % 8 else "old"))
    return out


def args(spark, path, data=None, **more):
    return dict(sections=spark.createDataFrame(data or rows(), ROWS), path=str(path), embed=embed("text"), target=TARGET, source_hash=F.concat(F.lit("hash-"), "text"), batch_rows=6) | more


def table(spark, path, data=None):
    return sorted(map(tuple, backfill.merged(spark.createDataFrame(data or rows(), ROWS), str(path)).collect()))


def test_backfill_stops_and_resumes_to_the_same_table(spark, tmp_path):
    whole = backfill.run(**args(spark, tmp_path / "a"))
    assert (whole.processed, whole.skipped, whole.failed, whole.remaining, whole.failed_remaining) == (24, 5, 1, 11, 11)
    made = {r[0]: r for r in table(spark, tmp_path / "a")}
    assert all(made[f"{k:03}"][3] == "READY" and made[f"{k:03}"][2] == [float(k + 1)] for k in (1, 2, 5, 8, 16)) and made["013"][3] == "FAILED" and made["003"][3] == "FAILED"

    def crash(one, path):
        if one.first()["batch"] == 2:
            raise KeyboardInterrupt
        backfill._commit(one, path)

    with pytest.raises(KeyboardInterrupt):
        backfill.run(**args(spark, tmp_path / "b", commit=crash))
    assert 0 < len(backfill._marks(spark, str(tmp_path / "b"))) == 2 and table(spark, tmp_path / "b") != table(spark, tmp_path / "a")
    again = backfill.run(**args(spark, tmp_path / "b"))
    assert again.processed < whole.processed and table(spark, tmp_path / "b") == table(spark, tmp_path / "a")
    assert backfill.run(**args(spark, tmp_path / "b")).processed == 0


def test_limit_dry_run_and_retry(spark, tmp_path):
    dry = backfill.run(**args(spark, tmp_path / "d", dry_run=True))
    assert (dry.processed, dry.remaining) == (25, 35) and table(spark, tmp_path / "d") == sorted(rows())
    few = backfill.run(**args(spark, tmp_path / "l", limit=7))
    assert (few.processed, few.failed, few.remaining) == (7, 0, 28)
    assert [r[0] for r, old in zip(table(spark, tmp_path / "l"), sorted(rows()), strict=True) if r != old] == [r[0] for r in sorted(rows()) if r[3] != "FAILED" and r[7] == "old"][:7]
    assert backfill.run(**args(spark, tmp_path / "l", limit=100)).remaining == 11
    assert backfill.run(**args(spark, tmp_path / "r", retry_failed=True)).remaining == 1
    assert backfill.run(**args(spark, tmp_path / "f", force=True)).processed == 39


def test_a_batch_that_raises_marks_its_rows_only(spark, tmp_path):
    found = backfill.run(**args(spark, tmp_path / "p", rows(poison=True)))
    failed = [r[0] for r in table(spark, tmp_path / "p", rows(poison=True)) if r[3] == "FAILED" and r[0] not in {x[0] for x in rows() if x[3] == "FAILED"}]
    assert "022" in failed and "013" in failed and 2 <= len(failed) <= 8 and found.failed == len(failed) and found.processed == 25 - len(failed)
    assert backfill.run(**args(spark, tmp_path / "e", data=None) | {"sections": spark.createDataFrame([], ROWS)}) == backfill.Counts(0, 0, 0, 0, 0)
