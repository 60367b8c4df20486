"""Titles by containment and the pruned best match, against all pairs."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from sextant.operators import fuzzy, mapping


def brute(pairs, least, margin):
    groups = {}
    for g, a, b, item, copies in pairs:
        if a is not None and b is not None:
            groups.setdefault(g, []).extend([(-difflib.SequenceMatcher(None, a, b).ratio(), item)] * copies)
    out = {}
    for g, found in groups.items():
        found.sort()
        best, item = -found[0][0], found[0][1]
        if best >= least:
            out[g] = (item, round(best, 9), len(found) < 2 or best + found[1][0] >= margin)
    return out


def candidate_pairs():
    rng = random.Random(4)
    letters = "abcde é"
    pairs = []
    for g in range(40):
        a = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        for k in range(rng.randint(1, 25)):
            near = list(a)
            for _ in range(rng.randint(0, 12)):
                near.insert(rng.randint(0, len(near)), rng.choice(letters))
            b = rng.choice(["".join(near), "".join(near), "".join(rng.choices(letters, k=rng.randint(0, 60))), "ab" * 150, None])
            pairs.append((g if g else None, a, b, g * 100 + k, rng.choice([1, 1, 1, 2])))
    return pairs


def test_best_match_equals_all_pairs_and_scores_few(spark, tmp_path):
    log = str(tmp_path)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(a)))
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    pairs = candidate_pairs()
    df = spark.createDataFrame(pairs, "g int, a string, b string, item int, copies int").withColumns({"_bound": F.lit(1), "score": F.lit("x")})
    rows = fuzzy.best_match(df, ["g"], "a", "b", "item", copies="copies", score=counted).collect()
    assert {r["g"]: (r["item"], round(r["score"], 9), r["sure"]) for r in rows} == brute(pairs, 0.5, 0.15)
    sent = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 0 < sent < len(pairs) / 3


def test_bounds_hold(spark):
    pairs = [(a, b) for _, a, b, _, _ in candidate_pairs() if b is not None]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fuzzy.by_length(a, b).alias("l"), fuzzy.by_letters(a, b).alias("m"), fuzzy.known_ratio(a, b).alias("k"), fuzzy.by_edits(a, b).alias("e"), fuzzy.edits_by_length(a, b).alias("el"), fuzzy.edits_by_letters(a, b).alias("em")).collect():
        true = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert true <= r["m"] + 1e-9 <= r["l"] + 2e-9 and (r["k"] is None or abs(r["k"] - true) < 1e-9)
        assert r["e"] <= r["em"] + 1e-9 and r["e"] <= r["el"] + 1e-9


def test_containment_joins_on_the_rarest_piece(spark):
    rng = random.Random(8)
    titles = sorted({" ".join(rng.choices(["act", "levy", "the", "code", "of", "lands"], k=rng.randint(1, 6))) for _ in range(200)})
    wanted = sorted({t[rng.randint(0, 3) : rng.randint(5, 30)] for t in titles} | {"act", "zzzz", "", "levy act"})
    df = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, act int")
    got = mapping.containing_titles(spark.createDataFrame([(w,) for w in wanted], "wanted string"), df).collect()
    assert sorted((r["wanted"], r["title"]) for r in got) == sorted((w, t) for w in wanted for t in titles if len(w) >= 4 and w in t)


def test_titles_resolve_once_exact_first(spark):
    acts = spark.createDataFrame([(1, "levy act"), (2, "social levy act"), (3, "lands act"), (4, "lands act"), (5, "a very long name of an act of lands"), (6, ""), (7, None), (8, "x" * 150 + " roads act of the many " + "y" * 80)], "id int, normalized_title string")
    wanted = ["levy act", "social levy", "lands act", "nds act", "evy act", "act", "x" * 150 + " roads act of the many", "nowhere act"]
    got = {r["wanted"]: (r["act"], r["kind"]) for r in mapping.resolve_titles(spark.createDataFrame([(w,) for w in wanted], "wanted string"), acts).collect()}
    # "evy act" is in two titles, the shorter being clearly nearer; "nds act" is in one title of two acts
    assert got == {"levy act": (1, "exact"), "social levy": (2, "partial"), "lands act": (3, "exact"), "nds act": (None, "partial"), "evy act": (1, "partial"), wanted[6]: (8, "partial")}


def test_chapters_inside_longer_text(spark):
    acts = spark.createDataFrame([(1, "t", "see Chapter 212A, p. 3", None), (2, "old chapter 21 act", None, None), (3, "u", None, "http://x/CHAPTER 9b.pdf"), (4, "v", "Chapter  7", "chapter x")], "id int, normalized_title string, source_name string, source_url string")
    places = {r["place"]: r["by_chapter"] for r in mapping.chapter_places(acts).collect()}
    assert places == {"chapter 2": 1, "chapter 21": 1, "chapter 212": 1, "chapter 212a": 1, "chapter 9": 3, "chapter 9b": 3}
    assert mapping.chapter_places(acts.drop("source_url", "source_name")).count() == 2


def test_title_pieces_are_not_broadcast(spark, tmp_path):
    # the pieces of titles are dozens of times the titles by whose size Spark would choose to broadcast them
    spark.createDataFrame([(f"levies of region {k}", k, 1) for k in range(50)], "title string, act int, holders int").write.parquet(f"{tmp_path}/titles")
    spark.createDataFrame([("region 7",)], "wanted string").write.parquet(f"{tmp_path}/wanted")
    found = mapping.containing_titles(spark.read.parquet(f"{tmp_path}/wanted"), spark.read.parquet(f"{tmp_path}/titles"))
    first_plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in first_plan and "Broadcast" not in first_plan
    assert {r["act"] for r in found.collect()} == {7}
