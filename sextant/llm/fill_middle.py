"""Fill-in-the-middle: texts are cut at unit ends into prefix, middle and suffix and written in another order.

One scan of the UTF-8 bytes by a table-driven automaton finds all that is needed. Its state is
how much of a sentinel has been read and whether a unit is open; a transition says what it
counts: a code point (any byte but a continuation byte), the end of a unit, a whole sentinel.
The state after a byte depends on that byte and the few before it only, so a buffer is scanned
in lanes side by side, each started a sentinel's length early. A second pass turns the cuts, as
numbers of units, into byte positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a transition counts.
CHAR, UNIT, MARK = 1, 2, 4
#: Bytes that a lane scans, and bytes of text that are scanned together (a longer text alone).
LANE, TOGETHER = 512, 4 << 20
SENTINELS = ("<P>", "<S>", "<M>")


def check_sentinels(sentinels: Sequence[str]) -> None:
    """Raise unless the sentinels can be told apart wherever a text ends next to one: none may begin with another's end."""
    for a in sentinels:
        for b in sentinels:
            if not a or a.encode() != a.encode("ascii", "ignore") or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a is not b))) or (a is not b and a in b):
                raise ValueError(f"sentinels must be ASCII, and neither overlap nor hold one another: {a!r}, {b!r}")


class Automaton:
    """Counts code points, units (each ends after ``unit_end``, the last also with its text) and sentinels."""

    def __init__(self, sentinels: Sequence[str], unit_end: str = "\n"):
        check_sentinels(sentinels)
        marks, stop = [s.encode() for s in sentinels], unit_end.encode()
        if len(stop) != 1:
            raise ValueError("a unit ends with one ASCII character")
        self.warm = max(map(len, marks), default=1)
        kinds = [stop[0], *sorted({b for m in marks for b in m} - {stop[0]})]
        # Classes of bytes: other first bytes, continuation bytes, the end of a text, then each byte that matters.
        self.other, self.inside, self.end = 0, 1, 2
        self.classes = np.zeros(256, np.uint8)
        self.classes[0x80:0xC0] = self.inside
        for k, b in enumerate(kinds):
            self.classes[b] = 3 + k
        names: list[bytes | None] = [None, None, None, *(bytes([b]) for b in kinds)]
        nodes = sorted({m[:k] for m in marks for k in range(len(m) + 1)} | {b""})
        self.width = len(names)
        table = np.zeros((2 * len(nodes), self.width), np.uint32)
        for n, read in enumerate(nodes):
            for is_open in (0, 1):
                for c, name in enumerate(names):
                    counts, goes, opens = (0 if c in (self.inside, self.end) else CHAR), b"", 1
                    if name is not None:
                        goes = next(seen for k in range(len(read) + 2) if (seen := (read + name)[k:]) in nodes or not seen)
                        counts |= MARK if any(goes.endswith(m) for m in marks) else 0
                    if c == self.end or name == stop:
                        counts |= UNIT if is_open or name == stop else 0
                        opens = 0
                    table[2 * n + is_open, c] = (2 * nodes.index(goes) + opens) * self.width << 3 | counts
        self.table, self.start = table.ravel(), 2 * nodes.index(b"") * self.width

    def scan(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each byte of ``data`` counts; texts end at the places ``ends``, which hold one byte more each."""
        lanes = max(-(-len(data) // LANE), 1)
        classes = np.full(self.warm + lanes * LANE, self.end, np.uint8)
        classes[self.warm : self.warm + len(data)] = self.classes[data]
        classes[self.warm + ends] = self.end
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(classes, (lanes, self.warm + LANE), (LANE, 1)).T)
        state, out = np.full(lanes, self.start, np.uint32), np.empty((LANE, lanes), np.uint8)
        for k, column in enumerate(steps):
            went = self.table[state + column]
            state = went >> 3
            if k >= self.warm:
                out[k - self.warm] = went & 7
        return out.T.reshape(-1)[: len(data)]


Cut = tuple[int, str, "int | None", "int | None", bytes]


def cut_texts(automaton: Automaton, sentinels: Sequence[str], texts: list[bytes], seeds: np.ndarray, rate: int, spm_rate: int) -> list[Cut]:
    """For each text: units, form, code points of prefix and middle, and the output. ``seeds``: four numbers for each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"\0".join([*texts, b""])
    data, ends = np.frombuffer(joined, np.uint8), np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = automaton.scan(data, ends)
    closes = np.flatnonzero(counts & UNIT)
    first, last = np.searchsorted(closes, starts), np.searchsorted(closes, ends, "right")
    n = last - first
    marked = np.zeros(len(texts), bool)
    marked[np.searchsorted(ends, np.flatnonzero(counts & MARK))] = True
    picks = np.sort(seeds[:, :2] % (n + 1)[:, None], axis=1)
    closes = np.concatenate((closes, [0]))
    at = np.where(picks > 0, np.minimum(closes[first[:, None] + picks - 1] + 1, ends[:, None]), starts[:, None])
    plain = (sizes == 0) | marked | (seeds[:, 2] % 100 >= rate)
    spm = seeds[:, 3] % 100 < spm_rate
    p, s, m = (x.encode() for x in sentinels)
    out: list[Cut] = []
    for k, (a, z, (x, y)) in enumerate(zip(starts.tolist(), ends.tolist(), at.tolist(), strict=True)):
        if plain[k]:
            out.append((int(n[k]), "plain", None, None, texts[k]))
            continue
        prefix, middle, suffix = joined[a:x], joined[x:y], joined[y:z]
        parts = (s, suffix, p, prefix, m, middle) if spm[k] else (p, prefix, s, suffix, m, middle)
        chars = [int(np.count_nonzero(counts[b:e] & CHAR)) for b, e in ((a, x), (x, y))]
        out.append((int(n[k]), "spm" if spm[k] else "psm", *chars, b"".join(parts)))
    return out


def _slices(size: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with about ``TOGETHER`` bytes, one row at least."""
    part = (np.cumsum(size) - size) // TOGETHER
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def fill_middle(docs: DataFrame, sentinels: Sequence[str] = SENTINELS, seed: str = "7", rate: int = 100, spm_rate: int = 50, unit_end: str = "\n") -> DataFrame:
    """Every row of ``docs`` as doc_id, n, form, prefix_chars, middle_chars, output.

    A text of ``n`` units (ended by ``unit_end``; the last may lack it) is cut before two of the n + 1 unit starts, chosen by hashes
    of ``seed`` and doc_id. sentinels: of prefix, suffix and middle. ``rate`` percent of the texts are changed, ``spm_rate`` percent
    of these with the suffix first; texts that are empty or hold a sentinel stay plain. A null text counts as
    empty, a null doc_id as the empty string; rows with the same doc_id are cut at the same hashes. Other columns are
    not read. A narrow map: nothing is shuffled, and a lost task is computed again alone.
    """
    automaton, kinds = Automaton(sentinels, unit_end), docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), digest.alias("digest")).select("doc_id", "text", *numbers)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _slices(size):
                part = batch.slice(a, b - a)
                seeds = np.column_stack([part.column(f"h{k}").to_numpy() for k in range(4)])
                n, form, prefix, middle, output = zip(*cut_texts(automaton, sentinels, part.column("text").to_pylist(), seeds, rate, spm_rate), strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = rows.mapInArrow(cut, f"doc_id {kinds}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from which ``fill_middle`` made ``output``. Sentinels do not occur in a text that was changed, so the first of each is its own."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substr(F.substring_index(output, b, 1), F.instr(output, a) + len(a)), b, 1)
    after = F.substr(output, F.instr(output, m) + len(m))
    return F.when(form == "psm", F.concat(between(p, s), after, between(s, m))).when(form == "spm", F.concat(between(p, m), after, between(s, p))).otherwise(output)
