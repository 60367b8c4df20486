"""Stems against an independent stemmer, the index against a scan."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sextant.functions import stems
from sextant.operators import fulltext

# Stems as published with the algorithm.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol console consol
conspicuous conspicu conspiracy conspiraci conspirator conspir constable constabl constancy constanc knack knack knave knave knavish knavish kneaded knead kneeling kneel knell knell knife knife knightly knight
happy happi hopping hop hoping hope relational relat conditional condit rational ration valenci valenc digitizer digit sky sky skies sky dying die agreed agre controlled control rolling roll cries cri by by say say
flies fli ties tie gas gas gaps gap this this kiwis kiwi generously generous generate generat communism communism arsenal arsenal electricity electr abilities abil hopefulness hope triplicate triplic formative format
formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt adjustment adjust probate probat rate rate cease ceas
bed bed shed shed red red sing sing luxuriating luxuri hissing hiss falling fall failing fail filing file tanned tan proceed proceed succeeds succeed inning inning herrings herring news news early earli only onli
youth youth boyish boyish yellow yellow enjoying enjoy cry cri beauty beauti apology apolog quickly quick universally univers""".split()


def independent(word):
    """The published rules once more, by positions and loops."""
    named = dict(zip(("skis skies dying lying tying idly gently ugly early only singly".split()), "ski sky die lie tie idl gentl ugli earli onli singl".split(), strict=True))
    if word in named:
        return named[word]
    if len(word) <= 2 or word in "sky news howe atlas cosmos bias andes".split():
        return word
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in "aeiouy"):
            w[i] = "Y"
    w = "".join(w)
    vowel = lambda c: c in "aeiouy"

    def region(start):
        i = start
        while i < len(w) and not vowel(w[i]):
            i += 1
        while i < len(w) and vowel(w[i]):
            i += 1
        return min(i + 1, len(w)) if i < len(w) else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(0) if r1 is None else r1
    r2 = region(r1)

    def short_end(x):
        if len(x) == 2:
            return vowel(x[0]) and not vowel(x[1])
        return len(x) > 2 and not vowel(x[-3]) and vowel(x[-2]) and not vowel(x[-1]) and x[-1] not in "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in "inning outing canning herring earring proceed exceed succeed".split():
        return w
    for e in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(e):
            if e in ("eedly", "eed"):
                w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
            elif any(map(vowel, w[: -len(e)])):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")) or False:
                    w += "e"
                elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = w[:-1]
                elif short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"
    two = dict(zip("tional enci anci abli entli izer ization ational ation ator alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi fulli lessli li".split(), "tion ence ance able ent ize ize ate ate ate al al al ful ous ous ive ive ble ble og ful less".split() + [""], strict=True))
    for e in sorted(two, key=len, reverse=True):
        if w.endswith(e):
            before = w[: -len(e)]
            if len(before) >= r1 and (e != "ogi" or before.endswith("l")) and (e != "li" or before[-1:] in tuple("cdeghkmnrt")):
                w = before + two[e]
            break
    three = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
    for e in sorted(three, key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= (r2 if e == "ative" else r1):
                w = w[: -len(e)] + three[e]
            break
    for e in sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def vocabulary():
    words = duckdb.sql("SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    made = [a + b for a in "gener commun arsen formal electr rational happ hop hopp relat yell boy sayy eye apple ll bl".split() for b in "e ed ing ingly edly eed eedly y ly li ogi logi ational ization fulness ousli iviti biliti ative icate ment ement ion sion s es ies ied us ss al er le ll".split()]
    return sorted({w for (w,) in words if re.fullmatch("[a-z]+", w)} | set(KNOWN[::2]) | set(made))


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in vocabulary()], "token string").withColumns({"w": F.lit("clash")}).drop("w")
    got = {r["token"]: r["lexeme"] for r in stems.with_stems(df).collect()}
    assert {w: got[w] for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))
    assert got == {w: independent(w) for w in got}


def test_stems_in_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS token", [[*vocabulary(), "x2", "42", "at"]])
    got = dict(con.execute("SELECT token, lexeme FROM (" + stems.stems_sql("t") + ")").fetchall())
    assert all(s == (independent(w) if re.fullmatch("[a-z]+", w) else w) for w, s in got.items())


ROWS = [(1, "Levies", "The levying of a levy on lands"), (2, None, "levied LANDS, and landed"), (3, "lands", None), (4, "", ""), (5, "the of and", "nothing"), (6, "x" * 10, "levy " * 5000 + "land")]


@pytest.fixture
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    fulltext.write_index(spark.createDataFrame(ROWS, "id int, title string, body string").withColumns({"n": F.lit(1), "token": F.lit("levy")}), "id", ["title", "body"], path, buckets=8)
    return path


@pytest.mark.parametrize("query", ["levy", "LEVYING the lands", "land levied nothing", "the and of", "", "missing levy", "levies levy", "xxxxxxxxxx land"])
def test_search_equals_a_scan(spark, index, query):
    def lexemes(text):
        return [independent(w) for w in re.split("[^a-z0-9]+", (text or "").lower()) if w and w not in stems.STOP_WORDS]

    wanted = set(lexemes(query))
    scan = {i: sum(found.count(w) for w in wanted) for i, *texts in ROWS if wanted and wanted <= set(found := [x for t in texts for x in lexemes(t)])}
    assert {r["id"]: r["n"] for r in fulltext.search_index(spark, index, query).collect()} == scan


def test_large_vocabularies_and_lists_are_joined_without_broadcast(spark, index, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BROADCAST_ROWS", 0)
    fulltext.write_index(spark.createDataFrame(ROWS, "id int, title string, body string"), "id", ["title", "body"], str(tmp_path / "again"), buckets=3)
    found = fulltext.search_index(spark, str(tmp_path / "again"), "levied land")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, fulltext.search_index(spark, index, "levied land").collect()))


def test_reads_only_the_lexemes_of_the_query(spark, index):
    plan = fulltext.search_index(spark, index, "levy land")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and plan.count("EqualTo(lexeme,") == 2 and "BroadcastHashJoin" in plan


def test_empty_table(spark, tmp_path):
    fulltext.write_index(spark.createDataFrame([], "id int, t string"), "id", ["t"], str(tmp_path / "none"))
    assert fulltext.search_index(spark, str(tmp_path / "none"), "levy").collect() == []


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_postings_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(fulltext, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(1, "running runs 77 ran"), (2, "Things, the thing"), (3, None)], "id long, body string")
    found = fulltext.postings(df, "id", ["body"])
    assert sorted(map(tuple, found.collect())) == [("77", 1, 1), ("ran", 1, 1), ("run", 1, 2), ("thing", 2, 2)]
    assert most == 0 or "hashpartitioning(lexeme" not in found._jdf.queryExecution().executedPlan().toString()
