"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes, h = 2 h + G[byte], ends a chunk where its top bits are
zero: 8 bits before the normal size of 64 bytes and 4 beyond it (normalised chunking), never
before 16 bytes and always at 512. Boundaries so depend on the text nearby,
not on what precedes it, and an insertion changes the chunks around it only. A fingerprint is
the set of chunk digests with their lengths in bytes; containment is the share of one set's
length whose digests the other has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import by_bucket, order_buckets

LEAST, NORMAL, MOST = 16, 64, 512
STRICT, LOOSE = 8, 4
GEAR = np.random.default_rng(1_031).integers(0, 1 << 32, 256, dtype=np.uint32)

Chunks = dict[int, int]


def _ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash has zero top bits: by the strict and by the loose rule."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        step = h.copy()
        step[k:] += h[:-k] << np.uint32(k)
        h = step
    loose = np.flatnonzero(h < (1 << (32 - LOOSE)))
    return loose[h[loose] < (1 << (32 - STRICT))], loose


def chunk_sets(texts: list[bytes]) -> list[Chunks]:
    """For each text its chunks' digests (48 bits) and lengths.

    The texts are hashed in one buffer: no boundary can lie in a text's first 15 bytes, so the
    window never reaches into the text before.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    strict, loose = (x.tolist() for x in _ends(np.frombuffer(joined, np.uint8))) if joined else ([], [])
    digest, out, stop = xxhash.xxh3_64_intdigest, [], 0
    i = j = 0
    for size in sizes.tolist():
        at, stop, found = stop, stop + size, {}
        while at < stop:
            end = min(at + MOST, stop)
            i = bisect_left(strict, at + LEAST - 1, i)
            if i < len(strict) and strict[i] < min(at + NORMAL - 1, end):
                end = strict[i] + 1
            elif at + NORMAL <= end:
                j = bisect_left(loose, at + NORMAL - 1, j)
                if j < len(loose) and loose[j] < end:
                    end = loose[j] + 1
            found[digest(joined[at:end]) >> 16] = end - at
            at = end
        out.append(found)
    return out


def as_text(chunks: Chunks) -> str:
    """Digests in order, each as 12 hex digits with 3 for its length; nothing for an empty text."""
    return "-".join(f"{d:012x}{n:03x}" for d, n in sorted(chunks.items()))


def containment(a: Chunks, b: Chunks) -> float:
    """The share of ``a``'s length that ``b`` contains; of an empty set: 1 in an empty one, else 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``after``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_neighbours(docs: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and likenesses (see ``SCHEMA``).

    The next document is the one before in doc_id (the order is descending; the last's next is
    the first; a single document's is itself). Equal doc_ids follow one another in order of their
    texts, a null doc_id counts as least, a null text as empty; other columns are not read. Texts
    are shuffled once, to ranges of doc_id; the first text of each range goes to
    the range before it too, so every row finds its next one in its own task.
    """
    least = -(2**63)
    turned = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)))  # ascending where doc_id descends
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), turned.alias("key"))
    dealt, count = order_buckets(rows, "key", "text", bucket_bytes)
    heads = dealt.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()  # one short row for each range
    first = [(h["bucket"], h["key"], heads[k - 1]["bucket"]) for k, h in enumerate(heads)]
    wanted = docs.sparkSession.createDataFrame(first, "bucket int, key long, receiver int")
    carried = dealt.join(F.broadcast(wanted), ["bucket", "key"]).groupBy("receiver").agg(F.min("text").alias("text"))
    carried = carried.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("key"), F.col("receiver").alias("bucket"), F.lit(True).alias("carry"))
    dealt = dealt.withColumn("carry", F.lit(False)).unionByName(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far, whose next one is to come
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held += zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("carry").to_pylist(), strict=True)
                if len(held) > 1:
                    yield compare(held)
                    held = held[-1:]

    def compare(held: list[tuple]) -> pa.RecordBatch:
        own = chunk_sets([t.encode() for _, t, _ in held])
        first = [i for i in range(len(held) - 1) if not held[i][2]]
        edits = [edited_text(held[i][1], held[i + 1][1]).encode() for i in first]
        other = chunk_sets(edits)
        columns = [
            pa.array([held[i][0] for i in first], pa.int64()),
            pa.array([len(held[i][1]) for i in first], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array([as_text(own[i]) for i in first], pa.string()),
            pa.array([as_text(x) for x in other], pa.string()),
            pa.array([containment(own[i], x) for i, x in zip(first, other, strict=True)], pa.float64()),
            pa.array([containment(own[i], own[i + 1]) for i in first], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return by_bucket(dealt, count, F.col("carry"), F.col("key"), F.col("text")).mapInArrow(run, SCHEMA)
