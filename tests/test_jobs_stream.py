"""The stream of job expiries against replay of the same events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sextant.operators import state
from sextant.streaming import jobs

T0 = datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, old)


def run(spark, folder, batches):
    """Feed the batches one after another, each as a file of its own."""
    schema = "job_id string, status string, created_at timestamp, at timestamp"
    source, mark = str(folder / "in"), str(folder / "checkpoint")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        query = jobs.expired_jobs(stream).writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(jobs.OUTPUT).parquet(str(folder / "out"))


def test_stream_equals_replay(rocks, tmp_path):
    spark, rng = rocks, random.Random(1)
    at = lambda m: T0 + timedelta(minutes=m)
    first = [(f"j{k}", "RUNNING", at(k), at(k)) for k in range(20)]
    second = [(f"j{k}", rng.choice(["COMPLETED", "FAILED"]), at(k), at(k + 25)) for k in range(0, 20, 3)]
    second += [("j1", "QUEUED", at(1), at(0))]  # older than what is known
    third = [("tick", "QUEUED", at(300), at(300))]
    late = [("j2", "COMPLETED", at(2), at(20)), ("tick", "COMPLETED", at(300), at(301))]  # far behind the watermark
    out = run(spark, tmp_path, [first, second, third, late]).collect()
    last = {}
    for r in sorted(out, key=lambda r: r["at"]):
        last[r["job_id"]] = (r["status"], r["reason"])
    ended = {j: s for j, s, _, _ in second if s != "QUEUED"}
    replay = spark.createDataFrame([(j, ended.get(j, "RUNNING"), c) for j, _, c, _ in first], "id string, status string, created_at timestamp_ntz")
    want = {r["id"]: r["status"] for r in state.expire_jobs(replay, at(290)).collect()}
    assert {j: s for j, (s, _) in last.items() if j != "tick"} == want
    assert all((last[j][1] == "interrupted by restart") == (j not in ended) for j in want)
    assert len([r for r in out if r["status"] == "FAILED" and r["reason"]]) == 20 - len(ended)
    assert all(r["at"] == at(int(r["job_id"][1:]) + 30) for r in out if r["reason"])
