"""Near-duplicates on word shingles: covering tables over SimHash fingerprints first, then an exact set-similarity join.

Fingerprints are taken of the sets of distinct shingles. ``simhash.near_links`` connects those that
differ in a few bits, however many copies a text has; each such link is checked by its whole sets.
A similarity of 0.8 alone moves some ten bits of 64, so that no usable radius finds all pairs. What is not
yet connected is therefore joined exactly.

The distinct shingles of a text are sorted by one order of all shingles. Two sets of a Jaccard
similarity of ``least`` or more share a shingle among the first |x| - ceil(least |x|) + 1 of
either, whatever the order is, so that every such pair meets at one of these. Shingles that are
common in a sample come last in the order: this spares pairs, and no pair depends on it. Pairs
that share enough of these are compared by their whole sets.

A pair is dropped before its sets are read where sketches of a fixed size tell that they differ in too many shingles; this drops no similar pair.

Texts stay where they are: what is written down of a row holds a hash of its text, by which those few whose sets are to be
compared are found again.

Shingles whose sets are all connected go. Of the sets that meet at another one, first each is compared with the
least. Only sets that are not yet connected are then compared pair by pair, so that many near copies of one text
do not make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded, drop, settle, settling
from sextant.llm.components import connected_components
from sextant.llm.simhash import majority, near_links

#: The order is learned from one row of this many; at most ``COMMON`` shingles seen ``OFTEN`` times there come last.
SHARE, OFTEN, COMMON = 8, 4, 1_000_000

_STEPS = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, sorted; A-Z lower-cased. A text of fewer words is one run."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), len(words))], np.uint64)
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs += each[k : k + len(runs)] * _STEPS[k]
    runs ^= runs >> np.uint64(31)
    return np.unique(runs * _STEPS[-1])


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of ``docs``, sorted, and how often they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    chosen = docs.where(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(SHARE)) == 0).select("text").distinct()
    counts = chosen.mapInArrow(cut, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by_token = np.argsort(token)
    return token[by_token], n[by_token]


#: The column with a text's hash.
TEXT_HASH = "text_hash"


def text_hash() -> Column:
    """What tells texts apart where they are not at hand."""
    return F.xxhash64("text")


#: Columns of a set's sketch: the parities of its shingles by their first byte, 64 to a column.
SKETCH = ["s0", "s1", "s2", "s3"]


def sketch(own: np.ndarray) -> np.ndarray:
    """The parities of ``own``. One shingle changes one of them, so two sets differ in as many shingles as their sketches in bits, or more."""
    odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_be_alike(x: str, y: str, m: str, n: str, least: float) -> Column:
    """Whether the sketches of sets of m and n shingles (columns that begin with x and y) allow the similarity: of it follows that they differ in a share of m + n at most."""
    bits = sum((F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH), F.lit(0))
    return bits <= F.lit((1 - least) / (1 + least)) * (F.col(m) + F.col(n)) + F.lit(1e-6)


def _hopeful(met: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of ``met`` (a, b, their sizes m, n; a row for each shingle shared by their fronts) that may be similar enough.

    Of the shingles that two sets share, all but those behind the front that ends first are in both fronts.
    """
    behind = F.ceil(F.lit(least) * F.greatest("m", "n") - F.lit(1e-9)) - 1
    need = F.lit(least / (1 + least)) * (F.col("m") + F.col("n")) - F.lit(1e-6)
    sizes = F.least("m", "n") >= F.lit(least) * F.greatest("m", "n") - F.lit(1e-9)
    return met.where(sizes).groupBy("a", "b", "m", "n").agg(F.count("*").alias("shared")).where(F.col("shared") + behind >= need).select("a", "b", "m", "n")


def _alike(pairs: DataFrame, docs: DataFrame, marked: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: keys, distinct) whose sets are similar enough. Only texts of these keys are moved, unless there are too many keys for a broadcast."""
    pairs = settle(pairs, "pairs")
    wanted = settle(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "wanted")
    places = settle(marked.join(bounded(wanted), "key", "left_semi").groupBy("key").agg(F.min(TEXT_HASH).alias(TEXT_HASH)), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * (1 + least) >= least * (len(x) + len(y)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = docs.select("text", text_hash().alias(TEXT_HASH)).join(bounded(places), TEXT_HASH).groupBy("key").agg(F.first("text").alias("text"))
    sets = settle(texts.mapInArrow(cut, "key long, own binary"), "sets", wide=True)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = settle(both.mapInArrow(compare, "a long, b long"), "alike", wide=True)
    for old in (sets, places, wanted, pairs):
        drop(old)
    return found


def _near(marked: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys whose fingerprints connect by links of ``radius`` or fewer differing bits."""
    prints = settle(marked.groupBy("key").agg(F.first("fp").alias("fp")), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("key").alias("rep")), "nodes")
    equal = prints.join(nodes, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return near_links(nodes, radius).unionByName(equal)


def _one_each(rows: DataFrame) -> DataFrame:
    """One of the rows (key, n, front) of each key. Those of a key of its own are not moved, if the others are few enough."""
    several = bounded(settle(rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "repeated"))
    first = rows.join(several, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("front").alias("front"))
    return rows.join(several, "key", "left_anti").unionByName(first)


def with_components(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` with ``component``: equal for rows that similar pairs connect (see ``components_of``)."""
    found = components_of(docs.select("text"), size, least, radius).distinct().withColumnRenamed(TEXT_HASH, "_hash")
    return docs.join(found, text_hash() == found._hash).select(*docs.columns, "component")


def components_of(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, their ``text`` replaced by ``text_hash``, with ``component``: equal for rows that similar pairs connect, each pair of a Jaccard similarity of ``least`` or more.

    Sets are the shingles of ``text``; other columns pass through. Rows of equal sets count once,
    whatever their number; texts without words have equal sets. ``radius``, the bits in which fingerprints may differ
    in the first pass, decides how much is left to the second, never the result. ``docs`` is read several times, so it
    should be cheap to read and the same each time.
    """
    with settling() as made:
        found = settle(_components_of(docs, size, least, radius), "components")
    for old in made[:-1]:
        drop(old)
    return found


def _components_of(docs: DataFrame, size: int, least: float, radius: int) -> DataFrame:
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_common(docs, size))
    names = [c for c in docs.columns if c != "text"] + [TEXT_HASH]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = order.value
        for batch in batches:
            keys, sizes, fronts, prints, parities = [], [], [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py().encode() if t.is_valid else None, size)
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                prints.append(majority(own))
                parities.append(sketch(own))
                seen = np.zeros(len(own), np.int64)
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    seen = np.where(common[at] == own, times[at], 0)
                front = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1 if len(own) else 0
                fronts.append(own[np.argsort(seen, kind="stable")[:front]].tobytes())
            more = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fronts, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            more += [pa.array(np.ascontiguousarray(c)) for c in np.array(parities, np.int64).reshape(-1, len(SKETCH)).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "key", "n", "front", "fp", *SKETCH])

    hashed = docs.withColumn(TEXT_HASH, text_hash())
    kinds = ", ".join(f"`{c}` {hashed.schema[c].dataType.simpleString()}" for c in names)
    marked = settle(hashed.mapInArrow(mark, f"{kinds}, key long, n int, front binary, fp long, {', '.join(f'{s} long' for s in SKETCH)}"), "marked", wide=True)
    sketches = settle(marked.groupBy("key").agg(*(F.first(s).alias(s) for s in SKETCH)), "sketches")
    near = _alike(_near(marked, radius), docs, marked, size, least)
    joined = settle(connected_components(near), "near")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fronts = batch.column("front").to_pylist()
            sizes = np.fromiter((len(x) // 8 for x in fronts), np.int64, len(fronts))
            key, n, c = (np.repeat(batch.column(name).to_numpy(), sizes) for name in ("key", "n", "c"))
            token = np.frombuffer(b"".join(fronts), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.array(n), pa.array(c)], ["token", "key", "n", "c"])

    nodes = _one_each(marked.select("key", "n", "front"))
    nodes = nodes.join(bounded(joined), nodes.key == joined.node, "left").select("key", "n", "front", F.coalesce("component", "key").alias("c"))
    rows = nodes.mapInArrow(spread, "token long, key long, n int, c long")
    own = Window.partitionBy("token")
    met = rows.withColumns({"low": F.min("c").over(own), "high": F.max("c").over(own), "to": F.min(F.struct("key", "n", "c")).over(own)})
    met = settle(met.where("low <> high").select("token", "key", "n", "c", "to"), "met")

    star = met.where("to.c <> c").select(F.col("to.key").alias("a"), F.col("key").alias("b"), F.col("to.n").alias("m"), "n")
    by_end = {end: sketches.select(F.col("key").alias(end), *(F.col(s).alias(f"{end}_{s}") for s in SKETCH)) for end in "ab"}
    hoped = _hopeful(star, least).join(by_end["a"], "a").join(by_end["b"], "b").where(_may_be_alike("a_", "b_", "m", "n", least)).select("a", "b")
    links = near.unionByName(_alike(hoped, docs, marked, size, least))
    found = settle(connected_components(links), "starred")

    placed = met.drop("c").join(found, met.key == found.node, "left").select("token", "key", "n", F.coalesce("component", "key").alias("c"))
    shares = placed.groupBy("token", "c").agg(F.count("*").alias("many")).groupBy("token")
    main = shares.agg(F.max_by("c", F.struct("many", "c")).alias("main"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    mixed = settle(placed.join(main.select("token", "main"), "token").join(sketches, "key"), "mixed")
    # each shingle once for each pair of sets of two components, at least one of them not the shingle's main one
    x, y = mixed.where("c <> main").alias("x"), mixed.alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))) & _may_be_alike("x.", "y.", "x.n", "y.n", least)
    first = F.col("x.key") < F.col("y.key")
    sides = {"a": ("x.key", "y.key"), "b": ("y.key", "x.key"), "m": ("x.n", "y.n"), "n": ("y.n", "x.n")}
    rest = x.join(y, meets).select(*(F.when(first, F.col(p)).otherwise(F.col(q)).alias(name) for name, (p, q) in sides.items()))
    every = links.unionByName(_alike(_hopeful(rest, least).select("a", "b"), docs, marked, size, least))

    moved = settle(connected_components(every), "moved")
    out = marked.select(*names, "key").join(bounded(moved), F.col("key") == F.col("node"), "left")
    return out.select(*names, F.coalesce("component", "key").alias("component"))
