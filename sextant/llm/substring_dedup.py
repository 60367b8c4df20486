"""Substring dedup by recompression.

Words are named by 64-bit hashes, the same everywhere. In each round symbols fall into two
classes by their name; a left-class symbol followed by a right-class one becomes one symbol,
named by a hash of the pair, if that spans no more than ``cap`` words. Equal neighbours
are of one class, so a run stays apart, symbol by symbol, however long it is: its interior has
the same names wherever a repeat of it begins (naming runs as a whole would make a name depend on
where the run ends, possibly outside a window). So equal stretches of words get equal interior symbols:
whether a symbol starts at a word after round j is settled by the 2^(j-1) words on either side.

With ``context`` = 2^(j-1) and ``cap`` = width - 2 context + 1, every window of ``width`` words
has such a start with its whole context inside. The context, shared, reveals a possible repeat:

1. Each group of documents sends the contexts at its symbol starts, each once, and learns which
   of them other groups have too.
2. It sends those windows of which every interior start is shared, with the least doc_id that
   has them, and learns of lesser ones elsewhere. Windows are compared by 96 bits, in all
   the words, so this verifies them.
3. It drops every word under a window that starts in a document with a smaller doc_id.

Words of one document stay in one group; groups are hashed, hold about ``group_bytes`` of text and
send a context or window once, however many of their documents have it; so a passage that very
many documents share is spread over all groups and costs each of them one entry.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import group_count

_U = np.uint64
_LAST = np.iinfo(np.int64).max


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = name
        return name


_NAMES = _Names()


def _join(x: np.ndarray, y: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for each pair."""
    z = x * _U(0x9E3779B97F4A7C15 + 2 * salt) + (y ^ (y >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
    z ^= z >> _U(29)
    z *= _U(0x165667B19E3779F9)
    return z ^ (z >> _U(32))


def shape(width: int) -> tuple[int, int, int]:
    """Rounds, context and cap for windows of ``width`` words (3 at least)."""
    if width < 3:
        raise ValueError("windows have 3 words at least")
    rounds = 1
    while 3 * 2**rounds <= width:
        rounds += 1
    context = 2 ** (rounds - 1)
    return rounds, context, width - 2 * context + 1


def symbol_starts(names: np.ndarray, rounds: int, cap: int) -> np.ndarray:
    """Where symbols start after ``rounds`` of pairing."""
    symbol, start = names, np.arange(len(names))
    size = np.ones(len(names), np.int64)
    for k in range(rounds):
        left = (symbol * _U(0xD6E8FEB86659FD93 + 2 * k)) >> _U(63) == 1
        pair = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= cap)
        first = np.flatnonzero(pair)
        symbol, size = symbol.copy(), size.copy()
        symbol[first] = _join(symbol[first], symbol[first + 1], k + 1)
        size[first] += size[first + 1]
        keep = np.ones(len(symbol), bool)
        keep[first + 1] = False
        symbol, start, size = symbol[keep], start[keep], size[keep]
    return start


def _stretches(names: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A name for every ``length`` consecutive words, by start."""
    count = len(names) - length + 1
    if count <= 0:
        return names[:0]
    power, size, at, whole = names, 1, 0, None
    while True:
        if length & size:
            part = power[at : at + count]
            whole = part if whole is None else _join(whole, part, salt)
            at += size
        if at == length:
            return whole
        power = _join(power[:-size], power[size:], salt)
        size *= 2


class _Group:
    """The documents of one group: their words, and what each word belongs to."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.doc_ids = np.array(table.column("doc_id").fill_null(_LAST), np.int64)
        self.words = [(t or b"").split() for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.names = np.fromiter(map(_NAMES.__getitem__, chain.from_iterable(self.words)), np.uint64, int(self.sizes.sum()))
        self.stops = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.begins = self.stops - np.repeat(self.sizes, self.sizes)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol starts whose context lies inside their document, and 48-bit names of the contexts."""
        rounds, context, cap = shape(self.width)
        at = symbol_starts(self.names, rounds, cap)
        at = at[(at - context >= self.begins[at]) & (at + context <= self.stops[at])]
        return at, _stretches(self.names, 2 * context)[at - context] >> _U(16)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows, and their 64-bit and 32-bit names."""
        count = max(len(self.names) - self.width + 1, 0)
        at = np.flatnonzero(np.arange(count) + self.width <= self.stops[:count])
        return at, _stretches(self.names, self.width)[at], (_stretches(self.names, self.width, 77)[at] >> _U(32)).astype(np.uint32)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The doc_id of each word."""
        return np.repeat(self.doc_ids, self.sizes)[at]


_WINDOW = np.dtype([("name", "<u8"), ("check", "<u4"), ("doc_id", "<i8")])


def _least(rows: np.ndarray) -> np.ndarray:
    """Each window once, in order, with its least doc_id."""
    if not len(rows):
        return rows
    order = np.lexsort((rows["check"], rows["name"]))
    rows = rows[order]
    new = np.flatnonzero(np.concatenate(([True], (rows["name"][1:] != rows["name"][:-1]) | (rows["check"][1:] != rows["check"][:-1]))))
    out = rows[new]
    out["doc_id"] = np.minimum.reduceat(rows["doc_id"], new)
    return out


def _dealt(group: int, entries: np.ndarray, buckets: np.ndarray, of: str) -> pa.Table:
    """Rows (bucket, g, payload) with the entries of each bucket."""
    order = np.argsort(buckets, kind="stable")
    entries, buckets = entries[order], buckets[order]
    edge = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True]))) if len(buckets) else np.zeros(1, np.int64)
    payload = [entries[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    numbers = pa.array(buckets[edge[:-1]].astype(np.int32), pa.int32()) if len(buckets) else pa.array([], pa.int32())
    same = pa.array(np.full(len(payload), group, np.int32), pa.int32())
    return pa.table({"bucket": numbers if of == "bucket" else same, "g": same if of == "bucket" else numbers, "payload": pa.array(payload, pa.binary())})


def _short(keys: np.ndarray) -> np.ndarray:
    """48-bit keys as rows of 6 bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _long(payloads: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view("<u8").reshape(-1)


ROWS = "bucket int, g int, payload binary"


def dedup_substrings(docs: DataFrame, width: int = 13, group_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text; others are not read).

    Words are split at ASCII white space; kept holds those that stay, joined by one space. A null
    or wordless text has none. Windows repeated within one document, or between rows that share a
    doc_id, remove nothing; a null doc_id counts as greater than any other. An empty table gives
    an empty result.
    """
    groups = group_count(docs, F.octet_length("text"), group_bytes)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int").alias("g"))

    def send_contexts(table: pa.Table) -> pa.Table:
        keys = np.unique(_Group(table, width).contexts()[1])
        return _dealt(table.column("g")[0].as_py(), _short(keys), (keys % _U(groups)).astype(np.int64), "bucket")

    def shared_contexts(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        keys = _long(payloads)
        source = np.repeat(table.column("g").to_numpy(), [len(p) // 6 for p in payloads])
        order = np.argsort(keys, kind="stable")
        keys, source = keys[order], source[order]
        equal = keys[1:] == keys[:-1]
        both = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        return _dealt(table.column("bucket")[0].as_py(), _short(keys[both]), source[both], "g")

    def send_windows(texts: pa.Table, replies: pa.Table) -> pa.Table:
        own = _Group(texts, width)
        at, keys = own.contexts()
        shared = np.isin(keys, np.sort(_long(replies.column("payload").to_pylist())))
        _, context, _ = shape(width)
        alone = np.zeros(len(own.names) + 1, np.int64)
        alone[at[~shared] + 1] = 1
        alone = np.cumsum(alone)
        start, name, check = own.windows()
        # interior starts lie from word ``context`` on to ``width - context`` of the window
        free = alone[start + width - context + 1] == alone[start + context]
        rows = np.empty(int(free.sum()), _WINDOW)
        rows["name"], rows["check"], rows["doc_id"] = name[free], check[free], own.owner(start[free])
        rows = _least(rows)
        return _dealt(texts.column("g")[0].as_py(), rows, (rows["name"] % _U(groups)).astype(np.int64), "bucket")

    def lesser_documents(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        rows = np.frombuffer(b"".join(payloads), _WINDOW)
        source = np.repeat(table.column("g").to_numpy(), [len(p) // _WINDOW.itemsize for p in payloads])
        order = np.lexsort((rows["check"], rows["name"]))
        rows, source = rows[order], source[order]
        if len(rows):
            new = np.concatenate(([True], (rows["name"][1:] != rows["name"][:-1]) | (rows["check"][1:] != rows["check"][:-1])))
            least = np.minimum.reduceat(rows["doc_id"], np.flatnonzero(new))[np.cumsum(new) - 1]
            told = least < rows["doc_id"]
            rows, source, least = rows[told].copy(), source[told], least[told]
            rows["doc_id"] = least
        return _dealt(table.column("bucket")[0].as_py(), rows, source, "g")

    def drop_words(texts: pa.Table, replies: pa.Table) -> pa.Table:
        own = _Group(texts, width)
        start, name, check = own.windows()
        here = np.empty(len(start), _WINDOW)
        here["name"], here["check"], here["doc_id"] = name, check, own.owner(start)
        told = np.frombuffer(b"".join(replies.column("payload").to_pylist()), _WINDOW)
        both = np.concatenate((here, told))
        order = np.lexsort((both["check"], both["name"]))
        rows = both[order]
        removed = np.zeros(len(here), bool)
        if len(rows):
            new = np.concatenate(([True], (rows["name"][1:] != rows["name"][:-1]) | (rows["check"][1:] != rows["check"][:-1])))
            least = np.minimum.reduceat(rows["doc_id"], np.flatnonzero(new))[np.cumsum(new) - 1]
            smaller = np.empty(len(both), bool)
            smaller[order] = least < rows["doc_id"]
            removed = smaller[: len(here)]
        change = np.zeros(len(own.names) + 1, np.int64)
        np.add.at(change, start[removed], 1)
        np.add.at(change, start[removed] + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, n_removed, at = [], [], 0
        for words in own.words:
            mask = gone[at : at + len(words)]
            at += len(words)
            n_removed.append(int(mask.sum()))
            kept.append(b" ".join(words if not n_removed[-1] else [w for w, g in zip(words, mask.tolist(), strict=True) if not g]))
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(own.sizes), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    by_group = dealt.groupBy("g")
    shared = by_group.applyInArrow(send_contexts, ROWS).groupBy("bucket").applyInArrow(shared_contexts, ROWS)
    sent = by_group.cogroup(shared.groupBy("g")).applyInArrow(send_windows, ROWS)
    lesser = sent.groupBy("bucket").applyInArrow(lesser_documents, ROWS)
    return by_group.cogroup(lesser.groupBy("g")).applyInArrow(drop_words, "doc_id long, n_words long, n_removed long, kept string")
