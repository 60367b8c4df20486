"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, every bit of a fingerprint gets a vector of r + 1 bits, and each of the
2^(r+1) - 1 non-zero vectors v gives a mask: the bits whose vector has an odd product with v.
The vectors of any r bits leave some v whose product with all of them is even, so that two
fingerprints that differ in r bits at most agree under the mask of that v: every such pair
meets in a table, with certainty. Pairs that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import drop, settle
from sextant.llm.components import connected_components

#: A run of more fingerprints that agree under a mask is compared in blocks of this size, in tasks of their own.
RUN = 8192


def masks(radius: int = 4, bits: int = 64) -> np.ndarray:
    """The covering family: signed 64-bit masks."""
    size = radius + 1
    vectors = np.random.default_rng(20_240_229).permutation(np.arange(bits) % (2**size - 1) + 1)  # each non-zero vector about as often
    out = []
    for v in range(1, 2**size):
        odd = np.bitwise_count(vectors & v) % 2 == 1
        out.append(sum(1 << int(k) for k in np.flatnonzero(odd)))
    return np.array(out, np.uint64).view(np.int64)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are 1 where over half of ``hashes`` (unsigned, 64 bits) have a 1; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Of one text (UTF-8): A-Z lower-cased; shingles of words, repeats included, hashed by XXH64 with seed 42."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(hashes)


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long; a null text has none of words, so zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _close(run: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of a forest over ``run`` (distinct fingerprints) with the same components as all its close pairs."""
    run, left = run.view(np.uint64), np.arange(len(run))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(run[left] ^ run[at]) <= radius
            if near.any():
                new = left[near]
                yield np.full(len(new), at), new
                front.extend(new.tolist())
                left = left[~near]


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between close fingerprints of equal key; rows sorted by key. Runs of over 8 give a forest, not all pairs."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    a, b = [], []
    small = np.repeat(size, size)
    for lag in range(1, 8):
        i = np.flatnonzero((small[:-lag] <= 8) & (key[lag:] == key[:-lag]))
        i = i[np.bitwise_count((fp[i] ^ fp[i + lag]).view(np.uint64)) <= radius]
        a.append(rep[i])
        b.append(rep[i + lag])
    for k in np.flatnonzero(size > 8):
        own = slice(edge[k], edge[k + 1])
        for x, y in _close(fp[own], radius):
            a.append(rep[own][x])
            b.append(rep[own][y])
    return np.concatenate(a), np.concatenate(b)


def _in_tables(nodes: DataFrame, family: list[int]) -> DataFrame:
    table = F.posexplode(F.array(*(F.lit(m).cast("long") for m in family)))
    return nodes.select("fp", "rep", table.alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links among ``nodes`` (fp, rep; fp distinct) that connect all pairs of ``radius`` or fewer differing bits.

    A task reads its (table, key) runs in order and holds one at a time. A run beyond ``RUN`` is
    only named; such runs are then dealt out anew in pairs of blocks, each a small task.
    """
    family = masks(radius).tolist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        heavy = None

        def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        def work(parts: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, heavy
            t, key, fp, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True]))
            edge = np.flatnonzero(new)
            stop = len(t) if last else edge[-2]
            size = np.diff(edge)
            if not last and size[-1] > RUN:  # the open run is too long already: keep just its name
                stop = len(t)
            over = np.flatnonzero((size > RUN) & (edge[:-1] < stop))
            names = {(int(t[i]), int(key[i])) for i in edge[over]}
            if heavy and (int(t[0]), int(key[0])) == heavy:
                names.add(heavy)
            light = ~np.repeat(np.isin(np.arange(len(size)), over) | np.array([(int(t[i]), int(key[i])) in names for i in edge[:-1]] if names else np.zeros(len(size), bool)), size)
            light[stop:] = False
            run = np.repeat(np.arange(len(size)), size)
            a, b = _links(run[light], fp[light], rep[light], radius) if light.any() else (fp[:0], fp[:0])
            if len(a):
                yield batch_of(0, a, b)
            if fresh := sorted(names - {heavy}):
                yield batch_of(1, np.array([x for x, _ in fresh], np.int64), np.array([x for _, x in fresh], np.int64))
            heavy = (int(t[-1]), int(key[-1])) if (int(t[-1]), int(key[-1])) in names else None
            held = [tuple(x[stop:] for x in (t, key, fp, rep))] if stop < len(t) else []

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp", "rep")))
                yield from work(held, last=False)
        if held:
            yield from work(held, last=True)

    dealt = _in_tables(nodes, family).repartition("t", "key").sortWithinPartitions("t", "key")
    found = settle(dealt.mapInArrow(scan, "kind int, a long, b long"), "links")
    links = found.where("kind = 0").select("a", "b").distinct()
    names = found.where("kind = 1").select(F.col("a").cast("int").alias("t"), F.col("b").alias("key")).distinct()
    if names.isEmpty():
        return links
    rows = _in_tables(nodes, family).join(names, ["t", "key"])
    blocks = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("n"))
    rows = rows.join(blocks, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})

    def block(group: pa.Table) -> pa.Table:
        fp, rep = (group.column(c).to_numpy() for c in ("fp", "rep"))
        pairs = list(_close(fp, radius))
        x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": rep[x], "b": rep[y]})

    return links.unionByName(rows.groupBy("t", "key", "x", "y").applyInArrow(block, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links of ``radius`` or fewer differing bits reach.

    Each row of ``docs`` (doc_id, text; others are not read) gives one row; rows with one doc_id
    but several texts belong together. A null doc_id forms no links: its component_id is null.
    Texts without words have fingerprint zero and link like any other. Equal fingerprints are
    merged, by a pre-aggregated minimum, before any pair is sought, so that groups of copies of
    any size count once. An empty table gives an empty result.
    """
    marked = settle(with_fingerprint(docs, shingle), "fingerprints")
    known = marked.where("doc_id is not null")
    nodes = settle(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = near_links(nodes, radius).unionByName(_same_id(known, nodes))
    found = connected_components(links)
    moved = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(moved, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _same_id(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the fingerprints of texts that share a doc_id."""
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id", "low")
    each = known.join(several, "doc_id").select("fp", "low").distinct()
    first = nodes.select(F.col("fp").alias("low"), F.col("rep").alias("b"))
    return each.join(nodes, "fp").join(first, "low").select(F.col("rep").alias("a"), "b")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
