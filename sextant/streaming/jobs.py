"""Expiry of running jobs as a stream: each job's state waits on an event-time timer. The batch form is ``state.expire_jobs``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "job_id string, status string, at timestamp, reason string"


class Expiry(StatefulProcessor):
    """Per job its status and when it was made. A job that is RUNNING when the watermark passes its time by ``minutes`` fails.

    Every change of status is put out once. An event that is older than what the state holds changes nothing; a job that has ended, or has
    expired, stays so, whatever arrives late.
    """

    def __init__(self, minutes: int):
        self.milliseconds = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, created long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, created, seen = self.held.get() if self.held.exists() else (None, None, -1)
        out, before = [], status
        events = sorted((int(r.at.value // 1_000_000), r.status, int(r.created_at.value // 1_000_000)) for part in rows for r in part.itertuples())
        for at, new, made in events:
            if at < seen or status in ("COMPLETED", "FAILED"):
                continue
            if new != status:
                out.append((key[0], new, pd.Timestamp(at, unit="ms"), None))
            status, created, seen = new, made if created is None else min(made, created), at
        if status is None:
            return
        self.held.update((status, created, seen))
        if before != "RUNNING" and status == "RUNNING":
            self.handle.registerTimer(created + self.milliseconds)
        if before == "RUNNING" and status != "RUNNING":
            self.handle.deleteTimer(created + self.milliseconds)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "status", "at", "reason"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, created, _ = self.held.get()
        if status == "RUNNING":
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.held.update(("FAILED", created, at))
            yield pd.DataFrame([(key[0], "FAILED", pd.Timestamp(at, unit="ms"), "interrupted by restart")], columns=["job_id", "status", "at", "reason"])

    def close(self) -> None:
        pass


def expired_jobs(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Changes of status of jobs (``OUTPUT``) from a stream of events: job_id, status, created_at, at.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). State is a row for each job.
    """
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), "status", F.col("created_at").cast("timestamp").alias("created_at"), F.col("at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(Expiry(minutes), OUTPUT, "Append", "EventTime")
