"""Approximate nearest neighbours over cell lists: vectors are written by the cell of their nearest centre, and searches read few cells."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sextant.operators.search import nearest

#: Vectors from which the centres are found, at most (drawn by a hash of the key), and rounds of k-means.
SAMPLE, ROUNDS = 50_000, 10
#: Rows that a tile of a cell, and queries that a part of them holds, about; queries whose products with a tile are held at a time.
TILE, TOGETHER = 16_384, 64


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _centres(rows: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Spherical k-means from rows drawn at random; a cell that loses all its rows takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    rows = _unit(rows)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = rows @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[lost] = rows[near.max(axis=1).argsort()[: len(lost)]]
        centres = _unit(sums)
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, queries: int = 500) -> int:
    """How many cells hold the share ``recall`` of the k nearest others of some rows: measured, by exact search among ``rows``.

    Of a sample the neighbours are farther than of the whole, so the number errs to the safe side.
    """
    rows = _unit(rows)
    asked = rows[:queries]
    near = asked @ rows.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, (rows @ centres.T).argmax(axis=1)[best], axis=1).ravel()) + 1
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) if len(needed) else 1


def _cell_of(centres: np.ndarray) -> Column:
    width = centres.shape[1]

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        fits = np.array([v is not None and len(v) == width and bool(np.isfinite(v).all()) for v in vectors], bool)
        out = np.full(len(vectors), -1, np.int32)
        if fits.any():
            out[fits] = (np.stack(vectors[fits].to_list()) @ centres.T).argmax(axis=1)
        return pd.Series(out)

    return cell("embedding")


def write_cells(rows: DataFrame, path: str, key: str = "section_id", cells: int = 64, recall: float = 0.95, seed: int = 7) -> None:
    """Write every row of ``rows`` (with ``embedding``) to ``path`` in folders by cell, the centres beside them.

    Centres come from ``SAMPLE`` valid vectors at most; every row is written, those without a valid vector (null, of
    another length, not finite) as cell -1, which searches leave out. A crowded cell is split into several files. The sample also
    says how many cells a search must probe for ``recall``: few where vectors form groups, most where they do not.
    """
    spark = rows.sparkSession
    valid = rows.where("embedding IS NOT NULL AND size(embedding) > 0").select("embedding", F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    drawn = [r["embedding"] for r in valid.orderBy("h").limit(SAMPLE).collect()]
    width = int(np.bincount([len(v) for v in drawn]).argmax()) if drawn else 1
    fit = np.array([v for v in drawn if len(v) == width and np.isfinite(v).all()], np.float64).reshape(-1, width)
    centres = _centres(fit, cells, seed) if len(fit) else np.zeros((1, width))
    placed = rows.withColumn("cell", _cell_of(centres))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    probes = _probes(fit, centres, recall) if len(fit) else 1
    spark.createDataFrame([(placed.schema.json(), probes)], "columns string, probes int").coalesce(1).write.parquet(f"{path}/layout")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    columns, probes = spark.read.parquet(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(columns))
    centres = sorted((r["cell"], r["centre"]) for r in spark.read.parquet(f"{path}/centres").collect())
    return spark.read.schema(schema).parquet(f"{path}/cells"), np.array([c for _, c in centres]), probes


def search_cells(spark: SparkSession, path: str, query: Sequence[float], k: int, probes: int | None = None, where: Column | None = None, key: str = "section_id") -> DataFrame:
    """The k nearest rows by cosine distance among those of the ``probes`` cells nearest to the query (default: as many as the index found to be enough).

    Distances are exact. Where a filter leaves fewer than k rows in the probed cells, twice as many are probed, until there are k or every cell
    has been; with all cells probed the result is that of an exact search.
    """
    table, centres, enough = _open(spark, path)
    probes = probes or enough
    order = (-(centres @ _unit(np.array([query], float))[0])).argsort(kind="stable").tolist()
    while True:
        rows = table.where(F.col("cell").isin(order[:probes]))
        rows = rows if where is None else rows.where(where)
        if probes >= len(order) or rows.select("cell").limit(k).count() >= k:
            return nearest(rows.drop("cell"), query, k, id_column=key)
        probes *= 2


def _best(rows: pa.Table, queries: pa.Table, key: pa.DataType, query: pa.DataType, k: int) -> pa.Table:
    """The k nearest of ``rows`` (key, embedding) for each of ``queries`` (query, vector), ties by key; products choose, then distances are taken exactly."""
    unit = lambda c, n: _unit(c.combine_chunks().flatten().to_numpy().reshape(n, -1))
    a, b = unit(rows.column("embedding"), rows.num_rows), unit(queries.column("vector"), queries.num_rows)
    out = []
    for first in range(0, len(b), TOGETHER):
        near = b[first : first + TOGETHER] @ a.T
        least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else -np.inf
        of, at = np.nonzero(near >= least - 1e-8)  # wider than what rounding may hide
        of += first
        exact = np.concatenate([(a[at[i : i + 65_536]] * b[of[i : i + 65_536]]).sum(axis=1) for i in range(0, len(of), 65_536)])
        found = pa.table({"of": of, "distance": np.round(1 - np.clip(exact, -1, 1), 9), "key": rows.column("key").take(pa.array(at))})
        found = found.take(pc.sort_indices(found, [("of", "ascending"), ("distance", "ascending"), ("key", "ascending")]))
        own = found.column("of").to_numpy()
        out.append(found.filter(pa.array(np.arange(len(own)) - np.searchsorted(own, own) < k)))
    found = pa.concat_tables(out)
    named = queries.column("query").take(found.column("of"))
    return pa.table({"query": named.cast(query), "key": found.column("key").cast(key), "distance": found.column("distance")})


def join_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, key: str = "section_id") -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query (query, vector) among its nearest cells.

    The rows of a cell are cut into tiles of about ``TILE`` by a hash of their key, queries into parts likewise. A query is sent to the
    tiles of its cells only. A tile meets one part of the queries at a time, as a product of two matrices of bounded size, and k rows for each
    query leave it; there are as many tasks as such meetings ask for. Queries without a valid vector find nothing.
    """
    table, centres, enough = _open(spark, path)
    probes = probes or enough
    width, table = centres.shape[1], table.where("cell >= 0").select(F.col(key).alias("key"), "embedding", "cell")
    valid = (F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    queries = queries.where(F.col("vector").isNotNull() & valid).select("query", "vector")
    n_rows = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
    n_tiles = np.array([-(-n_rows.get(c, 0) // TILE) for c in range(len(centres))], np.int32)
    start = np.cumsum(n_tiles) - n_tiles
    n_queries = queries.count()
    parts = max(1, -(-n_queries // TILE))

    @F.pandas_udf("array<int>")
    def tiles(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        near = (-(np.stack(vectors.to_list()) @ centres.T)).argsort(axis=1, kind="stable")[:, :probes]
        return pd.Series([np.concatenate([np.arange(start[c], start[c] + n_tiles[c], dtype=np.int32) for c in own]) for own in near])

    of_cell = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
    tile = of_cell(start) + F.pmod(F.xxhash64("key"), of_cell(n_tiles)).cast("int")
    rows = table.select("key", "embedding", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    sent = queries.select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"), F.explode(tiles("vector")).alias("tile"))
    tasks = max(1, -(-(sum(n_rows.values()) * parts + n_queries * int(np.sort(n_tiles)[::-1][:probes].sum())) // (4 * TILE)))
    kinds = {name: frame.schema[name].dataType for name, frame in (("key", table), ("query", queries))}
    arrow = {name: to_arrow_type(kind) for name, kind in kinds.items()}
    dealt = [x.repartition(tasks, "tile", "part").groupBy("tile", "part") for x in (rows, sent)]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return _best(a, b, arrow["key"], arrow["query"], k)
        return pa.table({"query": pa.array([], arrow["query"]), "key": pa.array([], arrow["key"]), "distance": pa.array([], pa.float64())})

    pairs = dealt[0].cogroup(dealt[1]).applyInArrow(meet, f"query {kinds['query'].simpleString()}, key {kinds['key'].simpleString()}, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("key", key)
