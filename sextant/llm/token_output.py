"""Token ids in binary files: patched frame-of-reference blocks.

A file row is a segment: whole documents in ascending order, at least ``SEGMENT`` ids unless it
ends a bucket. Its payload is, little-endian: magic, number of ids, number of blocks; for each
block its minimum (u4), start in the body (u4), bit width (u1) and number of exceptions (u1);
then the body. A block holds 256 ids (the last is padded with its minimum) as differences from
the minimum, packed at the width that holds ``PERCENT`` of them; each wider one is packed as 0
and listed as an exception (position u1, id u4). Starts are indexed, so that a block can be
read alone. Segments are rows of Parquet, written by Spark's committer, so that lost
executors leave no half-written output.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import WIDE, bounded, by_bucket, having, order_buckets, runs_at

BLOCK, SEGMENT, PERCENT, MAGIC = 256, 1 << 16, 95, b"PFR1"
_HEAD = struct.Struct("<4sII")


def pack(ids: np.ndarray) -> bytes:
    """The payload of one segment."""
    ids = np.asarray(ids, dtype=np.uint32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return _HEAD.pack(MAGIC, 0, 0)
    grid = np.empty((blocks, BLOCK), np.uint32)
    grid.reshape(-1)[: len(ids)] = ids
    if rest := blocks * BLOCK - len(ids):
        grid.reshape(-1)[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
        assert rest < BLOCK
    least = grid.min(axis=1)
    gap = grid - least[:, None]
    bits = np.frexp(gap)[1].astype(np.uint8)
    place = -(-BLOCK * PERCENT // 100) - 1
    width = np.partition(bits, place, axis=1)[:, place]
    odd = bits > width[:, None]
    n_odd = odd.sum(axis=1)
    size = width.astype(np.int64) * (BLOCK // 8) + 5 * n_odd
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    body = np.zeros(int(size.sum()), np.uint8)
    gap[odd] = 0
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            wide = np.unpackbits(gap[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, count=int(w), bitorder="little")
            body[start[own][:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(wide.reshape(len(own), -1), axis=1, bitorder="little")
    block, place = np.nonzero(odd)
    within = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    at = start[block] + width[block].astype(np.int64) * (BLOCK // 8)
    body[at + within] = place
    values = grid[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(at + n_odd[block] + 4 * within)[:, None] + np.arange(4)] = values
    heads = (least.astype("<u4"), start.astype("<u4"), width.astype(np.uint8), n_odd.astype(np.uint8))
    return b"".join([_HEAD.pack(MAGIC, len(ids), blocks), *(h.tobytes() for h in heads), body.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one segment."""
    magic, n, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at, heads = _HEAD.size, []
    for kind in ("<u4", "<u4", "u1", "u1"):
        heads.append(np.frombuffer(payload, kind, blocks, at))
        at += heads[-1].nbytes
    least, start, width, n_odd = heads
    start = start.astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=at)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = body[start[own][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
            whole = np.packbits(bits, axis=2, bitorder="little")
            value = np.zeros((len(own), BLOCK, 4), np.uint8)
            value[:, :, : whole.shape[2]] = whole
            grid[own] = value.view("<u4")[:, :, 0]
    grid += least[:, None]
    many = n_odd.astype(np.int64)
    block = np.repeat(np.arange(blocks), many)
    within = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    at = start[block] + width[block].astype(np.int64) * (BLOCK // 8)
    values = body[(at + many[block] + 4 * within)[:, None] + np.arange(4)]
    grid[block, body[at + within]] = np.ascontiguousarray(values).view("<u4").reshape(-1)
    return grid.reshape(-1)[:n]


class _Kept(dict):
    """Pieces and the bytes of their ids; a new piece is encoded when it is asked for. Pieces made up of others are not kept."""

    def __init__(self, tokenizer, most: int):
        super().__init__({"": b""})
        self.tokenizer, self.most = tokenizer, most

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".,|" and piece[-2] < "\u0130" and piece[-2].isalpha():  # letters that NFC and lower-casing leave letters
            return self[piece[:-1]] + self[piece[-1]]
        if self.lowers and piece.isascii() and (low := piece.lower()) != piece and "<|" not in piece:
            return self[low]
        if self.letters and piece.isalpha() and max(piece) < "\u0130":  # one piece to the pre-tokenizer, so its model alone gives the ids
            ids = [token.id for token in self.tokenizer.model.tokenize(piece.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = array("I", ids).tobytes()
        if len(self) < self.most and len(piece) < 64:
            self[piece] = ids
        return ids

    @cached_property
    def letters(self) -> dict[int, str]:
        """What the tokenizer makes of the letters below U+0130 before its model sees them; empty unless runs of them stay whole."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or cut is None or any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            return {}
        every = [c for c in map(chr, range(0x130)) if c.isalpha()]
        parts = [[p for p, _ in cut.pre_tokenize_str(normal.normalize_str(c))] for c in every]
        whole = [p for p, _ in cut.pre_tokenize_str(normal.normalize_str("".join(every + every[::-1])))]
        if any(len(p) != 1 for p in parts) or whole != ["".join(p[0] for p in parts + parts[::-1])]:
            return {}
        return {ord(c): p[0] for c, p in zip(every, parts, strict=True)}

    @cached_property
    def lowers(self) -> bool:
        return self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, with the ids of frequent pieces kept.

    The tokenizer must never join or change characters across a space, line feed or the step from
    a letter to one of ``.,|`` (true of any whose pre-tokenizer splits there); pieces between
    these are then encoded on their own. At most ``keep`` pieces are kept.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.kept = _Kept(Tokenizer.from_file(path), keep)

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.large_string()))[0]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large_string, null: empty), and how many each has. Each distinct piece is looked up once."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if self.kept.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # no text may turn into a special token
            texts = pc.ascii_lower(texts)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        blobs = [self.kept[piece] for piece in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        at, edge = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        total = np.concatenate(([0], np.cumsum(sizes[at])))
        return runs_at(np.frombuffer(b"".join(blobs), "<u4"), sizes, at), np.diff(total[edge - edge[0]])


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` with about ``most`` bytes of text together, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


class _OfWorker:
    """The encoder of a Python worker, made there when first asked for. As a broadcast it serves tasks that follow one another, and goes with the first task of another query."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.path)


FILE_SCHEMA = "bucket int, segment int, n_tokens long, doc_ids array<long>, doc_starts array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, bucket_bytes: int = 16 << 20) -> None:
    """Write the ids of every whole ``text`` of ``docs``, in ascending ``doc_id`` order, to ``path``.

    A null text counts as empty: its only id is ``end_id``. Rows with equal doc_id follow one
    another in order of their texts; a null doc_id comes first and is kept. Other columns are not
    read. Texts are shuffled once, to buckets of about ``bucket_bytes``; no id passes the driver.
    """
    rows = docs.select("doc_id", "text")
    dealt, count = order_buckets(rows, "doc_id", "text", bucket_bytes)
    own = docs.sparkSession.sparkContext.broadcast(_OfWorker(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, names = own.value.encoder, ["bucket", "segment", "n_tokens", "doc_ids", "doc_starts", "payload"]
        end, held = np.array([end_id], dtype="<u4"), []
        state = {"bucket": None, "segment": 0, "length": 0}

        def close() -> pa.RecordBatch:
            sizes = [len(x) for _, x in held]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
            row = [state["bucket"], state["segment"], sum(sizes), [d for d, _ in held], starts, pack(np.concatenate([x for _, x in held]))]
            state.update(segment=state["segment"] + 1, length=0)
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for part in (p for batch in batches for p in _chunks(batch, 3 << 20)):
            ids, sizes = ids_of.batch(part.column("text").cast(pa.large_string()))
            stops = np.cumsum(sizes)
            for bucket, doc_id, a, b in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), (stops - sizes).tolist(), stops.tolist(), strict=True):
                if bucket != state["bucket"]:
                    if held:
                        yield close()
                    state.update(bucket=bucket, segment=0)
                held.append((doc_id, np.append(ids[a:b], end)))
                state["length"] += b - a + 1
                if state["length"] >= SEGMENT:
                    yield close()
        if held:
            yield close()

    ordered = by_bucket(dealt, count, F.col("doc_id").asc_nulls_first(), F.col("text"))
    with having(docs.sparkSession, WIDE):
        ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)
    own.unpersist()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files, for each document: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("bucket", "segment").agg(F.sum("n_tokens").alias("n"))
    in_bucket = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.groupBy("bucket").agg(F.sum("n").alias("n"))
    in_all = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select("bucket", F.coalesce(F.sum("n").over(in_all), F.lit(0)).alias("before"))
    places = sums.select("bucket", "segment", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)).alias("local")).join(before, "bucket")
    places = bounded(places.select("bucket", "segment", (F.col("local") + F.col("before")).alias("first")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, starts, payload in zip(*(batch.column(c) for c in ("first", "doc_ids", "doc_starts", "payload")), strict=True):
                ids = unpack(payload.as_py()).astype("<u4", copy=False)
                begin = starts.values.to_numpy()
                ends = np.append(begin[1:], len(ids))
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begin + first.as_py()), pa.array(ends - begin), pa.array(crcs, pa.int64())], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    placed = files.join(places, ["bucket", "segment"]).select("first", "doc_ids", "doc_starts", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
