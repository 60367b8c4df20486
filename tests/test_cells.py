"""Cell lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import cells, search
from sextant.sources import bindings as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    cells.write_cells(T.vectors(spark, SF), path, cells=32)
    return path


@pytest.fixture(scope="module")
def exact(spark):
    rows = sorted((r["section_id"], r["embedding"]) for r in T.vectors(spark, SF).collect())
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return {int(q): set(ids[np.argsort(1 - m @ m[k], kind="stable")[:10]].tolist()) for k, q in enumerate(ids) if q % 20 == 0}


def test_recall_of_all_queries(spark, index, exact):
    queries = T.vectors(spark, SF).where("section_id % 20 = 0").select(F.col("section_id").alias("query"), F.col("embedding").alias("vector"))
    found = {}
    for r in cells.join_cells(spark, index, queries, 10).collect():
        found.setdefault(r["query"], set()).add(r["section_id"])
    recall = np.mean([len(found[q] & want) / 10 for q, want in exact.items()])
    print(f"recall@10 {recall:.4f}, probes {spark.read.parquet(index + '/layout').first()['probes']} of 32")
    assert set(found) == set(exact) and all(len(x) == 10 for x in found.values()) and recall >= 0.9


def test_grouped_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(16, 24))
    rows = [(k, (middles[k % 16] + 0.15 * rng.normal(size=24)).tolist()) for k in range(1600)]
    path = str(tmp_path / "grouped")
    df = spark.createDataFrame(rows, "section_id int, embedding array<double>")
    cells.write_cells(df, path, cells=16)
    assert spark.read.parquet(path + "/layout").first()["probes"] <= 3
    queries = df.where("section_id % 20 = 0").select(F.col("section_id").alias("query"), F.col("embedding").alias("vector"))
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = [(r["query"], r["section_id"]) for r in cells.join_cells(spark, path, queries, 10).collect()]
    want = {(q, int(i)) for q in range(0, 1600, 20) for i in np.argsort(1 - m @ m[q])[:10]}
    assert len(want.intersection(found)) >= 0.9 * len(want)


def test_single_search_agrees_and_is_exact_with_all_cells(spark, index):
    rows = T.vectors(spark, SF)
    probe = rows.where("section_id = 40").first()["embedding"]
    columns = ["section_id", "distance", "score"]
    want = search.nearest(rows, probe, 10).select(*columns).collect()
    assert cells.search_cells(spark, index, probe, 10, probes=32).select(*columns).collect() == want
    few = cells.search_cells(spark, index, probe, 10)
    assert len({r["section_id"] for r in few.collect()} & {r["section_id"] for r in want}) >= 8
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().executedPlan().toString()


def test_filter_that_empties_the_probes_is_refilled(spark, index):
    rows = T.vectors(spark, SF)
    probe = rows.where("section_id = 40").first()["embedding"]
    kept = F.col("section_id") % 100 == 7
    got = [r["section_id"] for r in cells.search_cells(spark, index, probe, 20, probes=1, where=kept).collect()]
    assert got == [r["section_id"] for r in search.nearest(rows.where(kept), probe, 20).collect()]
    assert cells.search_cells(spark, index, probe, 5, where=F.lit(False)).collect() == []


def test_invalid_vectors_and_empty_table(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (8, [0.0, 0.0])]
    schema = "section_id int, embedding array<double>"
    path = str(tmp_path / "a")
    cells.write_cells(spark.createDataFrame(rows, schema).withColumn("key", F.lit("clash")), path, cells=2)
    assert spark.read.parquet(path + "/cells").count() == len(rows)
    assert [r["section_id"] for r in cells.search_cells(spark, path, [1.0, 0.0], 9, probes=2).collect()][:4] == [1, 7, 7, 2]
    cells.write_cells(spark.createDataFrame([], schema), str(tmp_path / "b"))
    assert cells.search_cells(spark, str(tmp_path / "b"), [1.0], 3).collect() == []


def test_tiles_of_a_cell_give_the_same_rows(spark, index, monkeypatch):
    queries = T.vectors(spark, SF).where("section_id % 20 = 0").select(F.col("section_id").alias("query"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, cells.join_cells(spark, index, queries, 10).collect()))
    monkeypatch.setattr(cells, "TILE", 80)
    seen = cells.join_cells(spark, index, queries, 10)
    assert sorted(map(tuple, seen.collect())) == whole


def test_copies_of_one_vector_are_ranked_by_key(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("section_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(-1.0), F.col("id").cast("double"))).alias("embedding"))
    cells.write_cells(rows, str(tmp_path / "cells"), cells=4)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0])], "query int, vector array<double>")
    got = cells.join_cells(spark, str(tmp_path / "cells"), queries, 4).orderBy("rank").collect()
    assert [(r["query"], r["section_id"], r["distance"]) for r in got] == [(1, 1, 0.0), (1, 2, 0.0), (1, 4, 0.0), (1, 5, 0.0)]
