"""Shared joins and windows on nulls, ties, repeats, empty tables and clashing names."""

from pyspark.sql import functions as F

from sextant.operators import rows, segments
from sextant.plans import catalogue


def test_joins(spark):
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (9, "d")], "parent int, id string")
    parents = spark.createDataFrame([(1, "x", 0), (2, None, 0), (3, "z", 0)], "id int, title string, parent int")
    assert sorted(map(tuple, rows.with_parent(kids, parents, "parent", "left", name="title").collect()), key=str) == [(1, "a", "x"), (2, "b", None), (2, "b", None), (9, "d", None), (None, "c", None)]
    assert rows.with_parent(kids, parents, "parent", name="title").count() == 3
    assert sorted(r["id"] for r in rows.having(kids, parents, "parent", "id").collect()) == ["a", "b", "b"]
    assert sorted(r["id"] for r in rows.having(kids, parents, "parent", "id", without=True).collect()) == ["c", "d"]
    assert sorted(r["id"] for r in rows.having_or(kids, parents.union(parents), "parent", "id", F.col("id") == "c").collect()) == ["a", "b", "b", "c"]
    assert [tuple(r) for r in rows.unique_keys(kids, ["parent"], "id").orderBy("id").collect()] == [(1, "a"), (None, "c"), (9, "d")]
    assert rows.having(kids.limit(0), parents, "parent", "id").collect() == [] and rows.having(kids, parents.limit(0), "parent", "id").collect() == []


def test_first_match(spark):
    wanted = spark.createDataFrame([(1, ["q", "x", "y"]), (2, ["q"]), (3, []), (4, None), (5, ["y", "x"])], "k int, forms array<string>")
    found = spark.createDataFrame([("x", 10), ("y", 20)], "form string, act int")
    assert {r["k"]: r["act"] for r in rows.first_match(wanted, "k", "forms", found, "form", "act").collect()} == {1: 10, 5: 20}


def test_windows(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 3, None), ("g", 4, None), ("g", 5, "a"), ("h", 1, None), ("h", 2, "  ")], "g string, k int, v string")
    assert [(r["g"], r["k"]) for r in rows.without_repeats(df, "g", "k", "v").orderBy("g", "k").collect()] == [("g", 1), ("g", 3), ("g", 5), ("h", 1), ("h", 2)]
    assert [r["until"] for r in rows.next_start(df, "g", "k", F.lit(99)).orderBy("g", "k").collect()] == [2, 3, 4, 5, 99, 2, 99]
    assert [r["sort_order"] for r in rows.numbered(df, "g", "k").orderBy("g", "k").collect()] == [0, 1, 2, 3, 4, 0, 1]
    assert [r["above"] for r in rows.text_above(df, "g", "k", "v", 2).orderBy("g", "k").collect()] == [None, "a", "a", "a", None, None, None]
    assert {r["g"]: r["kept"] for r in rows.distinct_in_order(df, "g", "k", "v").collect()} == {"g": ["a"], "h": ["  "]}


def test_more_rows_make_more_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(12)], "id int, raw_text string")
    assert rows.dealt(df, "id", F.lit(rows.TASK_BYTES) / 2).rdd.getNumPartitions() == 6
    assert rows.dealt(df.limit(0), "id", F.lit(1)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(segments, "LINE_BYTES", rows.TASK_BYTES)
    assert segments.line_table(df, "id", "raw_text").rdd.getNumPartitions() > 12


def test_parents_of_hot_and_null_keys(spark):
    children = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3) for k in range(300)], "n int, parent int")
    parents = spark.createDataFrame([(k, f"p{k}") for k in range(2, 2000)], "id int, title string")
    joined = rows.with_parent(children, parents, "parent", "left", few=True, title="title")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["n"]: r["title"] for r in joined.collect()} == {k: "p2" if k % 3 == 2 else None for k in range(300)}
    assert rows.with_parent(children, parents, "parent", few=True, title="title").count() == 100


def test_native_first_is_dealt_by_size(spark, tmp_path, monkeypatch):
    lines = [(k // 3, k % 3 + 1, float(k % 50)) for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    monkeypatch.setattr(rows, "dealt", lambda df, key, weight: asked.append(key) or df.repartition(7, key))
    assert catalogue.queries()["doc_native_first"](spark, str(tmp_path)).count() == 20
    assert asked == ["l_orderkey"]
