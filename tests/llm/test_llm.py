"""The training-data operators against brute force on small tables with nulls, ties, repeats, empty and clashing input."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sextant.llm import chunks, common, components, decontaminate, html_text, language_id, lm_model, lm_score, mixing, queries, set_join, simhash, substring_dedup, token_output, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(spark, texts, **more):
    rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


# --- 1 substring dedup ---


def brute_dedup(rows, width):
    seen = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = min(seen.get(k, math.inf), math.inf if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] < (math.inf if d is None else d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "letters"), [(13, "ab"), (13, "abcdefghij"), (5, "abc"), (3, "ab")])
def test_dedup_matches_brute_force(spark, width, letters):
    rng = random.Random(width * 100 + len(letters))
    base = [[rng.choice(letters) for _ in range(rng.randint(0, 60))] for _ in range(12)]
    rows = []
    for k in range(60):
        t = [*rng.choice(base)[rng.randint(0, 9) :], *(rng.choice(letters) for _ in range(rng.randint(0, 9))), *rng.choice(base)]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(t)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "é" * 3), (None, rows[0][1]), (5, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("clash")).withColumn("kept", F.lit(1))
    got = substring_dedup.dedup_substrings(df, width, group_bytes=300)
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(rows, width)


def test_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(docs_of(spark, [])).count() == 0


def test_boundaries_lie_in_every_window():
    rng = np.random.default_rng(1)
    for width in (3, 5, 13, 26, 50):
        rounds, context, cap = substring_dedup.shape(width)
        for letters in (1, 2, 1000):
            names = rng.integers(0, letters, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = set(substring_dedup.symbol_starts(names, rounds, cap).tolist())
            for s in range(100, 2800):
                assert any(p in at for p in range(s + context, s + width - context + 1))
            # what settles a boundary lies within its context
            p = 1500
            cut = names[p - context : p + context]
            alone = np.concatenate((rng.integers(0, 99, 50).astype(np.uint64), cut, rng.integers(0, 99, 50).astype(np.uint64)))
            assert (50 + context in substring_dedup.symbol_starts(alone, rounds, cap).tolist()) == (p in at)


# --- 2 token output ---


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 2**32])
def test_blocks_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 2**32 - 1
    assert (token_output.unpack(token_output.pack(ids)) == ids).all()


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(queries.tokenizer_path()), token_output.Encoder(queries.tokenizer_path())
    for text in ["it's, don't. I'LL|x É. éa. ĂŚ́. ا.", "á. x\u0085y z", "<|endoftext|>. a<|endoftext|>b, ΣΑΣ. İ, ß| 12.5, 1. x'.", "  \n\n a. . .. a.. b.| '|s 's. |", "́. .́ a.́", "ﬁ. Ⅷ. ª. ².", "THE. The, tHe <|STARTOFTEXT|>.", ""]:
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(7, "one two"), (3, None), (3, "a b c"), (None, "null id"), (9, ""), (-4, "x " * 70_000), (11, "last.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    token_output.write_tokens(df, str(tmp_path / "t"), queries.tokenizer_path(), end_id=1, bucket_bytes=50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, str(tmp_path / "t")).collect())
    want, start = [], 0
    for d, x in sorted(rows, key=lambda r: (-math.inf if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    token_output.write_tokens(df.limit(0), str(tmp_path / "e"), queries.tokenizer_path(), end_id=1)
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_letters_skip_the_pre_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(queries.tokenizer_path()), token_output.Encoder(queries.tokenizer_path())
    assert len(e.kept.letters) > 150
    rng = np.random.default_rng(4)
    for _ in range(3000):
        piece = "".join(rng.choice([*map(chr, e.kept.letters)], int(rng.integers(1, 20))))
        assert e(piece).tolist() == t.encode(piece, add_special_tokens=False).ids


def test_order_buckets_split_hot_keys(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abé"), 40)) for _ in range(600)] + [None, ""]
    rows = [(None if k % 3 else int(rng.integers(-5, 5)), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, count = common.order_buckets(df, "doc_id", "text", 1000)
    got = [(-math.inf if r.doc_id is None else r.doc_id, r.text or "", r.bucket) for r in dealt.collect()]
    assert [b for _, _, b in sorted(got)] == sorted(b for _, _, b in got)
    assert count > 20 and max(Counter(b for _, _, b in got).values()) < 100
    same = common.order_buckets(df.select(F.lit(None).cast("long").alias("doc_id"), "text"), "doc_id", "text", 1000)[0]
    assert max(Counter(r.bucket for r in same.collect()).values()) < 100
    assert common.order_buckets(df.limit(0), "doc_id", "text", 1000)[0].count() == 0


def test_token_files_in_order_of_repeated_ids(spark, tmp_path):
    rows = [(None, f"t{k:03d} " * 30) for k in range(200)] + [(5, "z"), (5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_output.write_tokens(df, str(tmp_path / "t"), queries.tokenizer_path(), end_id=1, bucket_bytes=500)
    e = token_output.Encoder(queries.tokenizer_path())
    want = [zlib.crc32(np.append(e(t), np.uint32(1)).astype("<u4").tobytes()) for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[1]))]
    got = token_output.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.ids_crc32 for r in got] == want


# --- 3 URL filters ---


def test_urls(spark):
    rows = [
        ("http://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://com/en/7", "com", "/en/7", "com/en/", "block"), ("x://notcom/en/", "notcom", "/en/", None, "allow"), ("x://com/en", "com", "/en", None, "allow"),
        ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"), ("com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("a://b.org#/es/", "b.org", "", None, "allow"), ("a://b.org/es/://com/en/", "b.org", "/es/://com/en/", "org/es/", "block"), ("a://É.COM/en/", "É.com", "/en/", "com/en/", "block"), ("x://com:80/en/", "com:80", "/en/", None, "allow"),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "page_id long, url string").withColumn("host", F.lit("clash")).repartition(2)
    got = url_filter.filter_urls(df, queries.RULES).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == rows
    assert url_filter.filter_urls(df.limit(0), queries.RULES).count() == 0
    tie = [("b.c", "/x", "allow"), ("c", "/x/y", "block"), ("b.c", "/x", "block")]
    assert url_filter.longest(url_filter.build_trie(tie), "b.c", "/x/y") == ("b.c/x", "block")
    assert url_filter.longest(url_filter.build_trie([]), "b.c", "/") is None


# --- 4 mixing ---


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.randint(0, 60)), None, rng.choice(["a", "b", "é", None, "big", "big", "big", "big"]), 0) for k in range(900)]
    rows += [(2000 + k, "same text here", None, "big", 0) for k in range(400)] + [(3000, None, None, "empty", 0), (3001, "", None, "empty", 0), (3001, "", None, "empty", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("rate", F.lit("clash"))
    got = mixing.mix(df).collect()
    again = sorted((r.doc_id, r.copies) for r in mixing.mix(df.repartition(3)).collect())
    assert again == sorted((r.doc_id, r.copies) for r in got) and len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    target = {s: fixed.get(s, level * weight[s]) for s in order}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.size * r.copies <= 3 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
    for s in order:
        assert abs(taken[s] - target[s]) <= 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_wordless_documents(spark):
    df = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 0)], DOCS)
    assert {(r.target, r.taken) for r in mixing.mix(df).collect()} == {(0.0, 0)}


# --- 5 decontamination ---


def brute_contaminated(rows, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, named = cut(t), set(), set()
        for win, who in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named |= who
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(5)
    text = lambda n, letters="abcdé": " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 14, 30]), "abcdefghij")) for k in range(12)] + [(50, None), (51, "..."), (0, "A b"), (60, "x-y_Z"), (61, text(25)), (62, "é É")]
    items.append((63, items[10][1]))
    rows = [(k, text(rng.randint(0, 40))) for k in range(40)] + [(100 + k, f"{text(3)} {x or ''}! {text(2)}".upper()) for k, (_, x) in enumerate(items)]
    rows += [(200, None), (201, ""), (202, "!!"), (None, items[11][1]), (None, "q"), (5, items[9][1]), (7, "é É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    got = decontaminate.contaminated_by(df, bench).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=str) == brute_contaminated(rows, items)
    assert decontaminate.contaminated_by(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated_by(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(f"i{k}", text(n)) for k, n in enumerate([30, 12, 10, 9, 4, 1, 0])] + [("i7", None), ("i0", text(14))]
    rows = [(None if k % 2 else k % 5, text(rng.randint(0, 300))) for k in range(60)] + [(None, None), (None, "z " + items[0][1])] * 3 + [(7, "q " * 200_000 + items[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("n", F.lit(1))
    got = decontaminate.contaminated_by(df, spark.createDataFrame(items, "item_id string, text string").withColumn("window", F.lit(0))).toPandas()
    want = sorted(brute_contaminated(rows, items), key=str)
    assert sorted(((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.itertuples()), key=str) == want


def test_decontamination_is_native(spark):
    got = decontaminate.contaminated_by(docs_of(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 6 HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="p12"><nav><a href="/">menu menu menu menu</a></nav><div class="ad">buy</div>
<article id=a><h1>Head</h1><p><b>One &amp; two<br><p>three<i>four</i>
 five<script>var t="</p>";</script></p><ul><li>x<li>y</ul><form>f <input></form><div class="comments"><p>no</div><aside>side</aside></article><footer>foot</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", PAGE.replace("article", "main")), (3, None, "<p>alone"), (4, "http://h/3", None), (5, "x", ""), (6, "http://h/4", "<nav>only menu</nav>"), (7, "http://h/5", "a < b <!-- c"), (8, "http://h/5", "<div class='x\"><p>t</p>"), (1, "http://h/1", PAGE)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()
    text = {r.page_id: r.text for r in got}
    want = "Head One & two threefour five x y"
    assert text == {1: want, 2: want, 3: "alone", 4: "", 5: "", 6: "", 7: "a < b", 8: text[8]} and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_hosts_vote():
    odd = "<body><div class=story1><p>short</p></div><div class=box><p>" + "longer text " * 9 + "</p></div></body>"
    assert html_text.extract(odd, "html/body/div.story") == "short"
    assert html_text.extract(odd, "html/body/none").startswith("longer")


def test_html_survives_anything():
    rng = random.Random(6)
    for _ in range(300):
        html_text.extract("".join(rng.choice(["<", ">", "</", "p", "div", " class=", '"', "'", "a", "&amp;", "&#x", "<!--", "<script", "/>", "\x00", "é"]) for _ in range(40)), "html/body")


STORY = "<article><h1>Title here</h1><p>The story is told in full.</p></article>"


@pytest.mark.parametrize(("html", "want"), [
    (f"<div class='layout has-sidebar'>{STORY}</div>", "Title here The story is told in full."),
    (f"<form id=aspnetForm>{STORY}</form>", "Title here The story is told in full."),
    ("<div class='story no-comments'><p>The story is told in full.</div>", "The story is told in full."),
    (f"<main class='main menu-open'>{STORY}</main>", "Title here The story is told in full."),
    (f"<div class='share-page'>{STORY}</div>", "Title here The story is told in full."),
    (f"<html><head><title>x</title><body>{STORY}", "Title here The story is told in full."),
    ("<head><meta charset=utf-8><title>x</title><p>No body tag at all.", "No body tag at all."),
    ("<div class=sidebar><p>Nothing but a sidebar.</p></div>", "Nothing but a sidebar."),
    ("<article><header><h1>Title</h1></header><p>Text of it.</p><footer>by</footer></article>", "Title Text of it."),
    (f"<header><h1>Site</h1></header><div id=page class='with-menu'><div class=menu><a href=x>Home</a></div>{STORY}<div class=ad>Buy</div></div>", "Title here The story is told in full."),
    (f"<body><div class=page>{STORY}<section class='comments'><article><p>{'I say it is so. ' * 9}</p></article></section></div>", "Title here The story is told in full."),
    (f"<body>{STORY}<form><input><label>Your mail</label></form><aside class=related><article><h1>Other</h1></article></aside>", "Title here The story is told in full."),
    ("<div class=w-1/2><p>Half.</p></div>", "Half."),
])
def test_wrappers_stay_and_parts_go(html, want):
    assert html_text.extract(html, None) == want
    best = html_text.container_scores(html)
    assert html_text.extract(html, max(best, key=best.get)) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<div>" * 50_000 + "</p>" * 50_000 + "x", "<li><b>" * 50_000 + "x", "<p>" * 100_000 + "x", "<head>" * 50_000 + "x", "<ul><li>" * 50_000 + "</ol>" * 50_000 + "x"])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    assert html_text.extract(page, "html/body/div") in ("deep", "x")
    assert time.process_time() - began < 6


def test_templates_by_hand(spark):
    """Hosts with different layouts; the text of every page is known beforehand."""
    rng, rows, want = random.Random(3), [], {}
    shells = [
        "<html><head><title>t</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id=main class='main has-sidebar'><div class=post{k}>{body}</div><div class=sidebar><p>{side}</p></div></div><footer>f</footer></body></html>",
        "<body class=single><form id=f><table><tr><td class=left><ul><li><a href=/a>Menu</a></ul><td class=story>{body}</table></form><div class=cookie-notice>{side}</div>",
        "<body><div class='layout-wrap'><aside>{side}</aside><article class=entry>{body}<div class='share social'>Share</div></article><div id=comments><p>{side} {side}</p></div></div>",
    ]
    for k in range(60):
        paragraphs = [" ".join(rng.choice(["salt", "river", "stone", "&eacute;t&eacute;", "owl"]) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(2, 6))]
        shell = shells[k % 3].replace("{k}", str(k)).replace("{body}", "".join(f"<p>{x}</p>" for x in paragraphs)).replace("{side}", "aside words here")
        rows.append((k, f"http://host{k % 3}.net/{k}", shell))
        want[k] = " ".join(paragraphs).replace("&eacute;", "é")
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_every_page_of_the_table(spark):
    from html import unescape

    got = {r.page_id: r.text for r in queries.op6_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br|div)", m[0]) else "", inner)).split())


# --- 7 languages ---


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_mixture_and_edges(spark):
    a, b = "der die das und nicht ein ist von mit sich " * 30, "the and of with that this from have are was " * 30
    train = spark.createDataFrame([(k, t, lang, "s", 0) for k in range(5) for t, lang in ((a, "de"), (b, "en"), (None, "en"), ("x", None))], DOCS)
    model = language_id.fit(train, F.lit(True))
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, a), (2, b), (3, a + b), (4, None), (5, ""), (6, "123 ..."), (7, "q"), (8, a * 50)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert got[1][0] == got[8][0] == "de" and got[2][0] == "en" and 0.3 < got[3][1] < 0.7
    assert got[4] == got[5] == got[6] == ("und", 0.0) and got[7][0] in ("de", "en")
    cells, counts = language_id.grams(a + b)
    assert len(language_id.proportions(model, cells, counts)) == 2
    empty = language_id.fit(train.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}


# --- 8 language model ---


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(900, None), (901, ""), (902, "É neverseenword"), (902, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("clash"))
    got = lm_score.score_documents(df, common.in_fold(F.col("doc_id"), 7, 2), queries.tokenizer_path("piece_bpe_32k.model"), group_bytes=20_000).toPandas()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    cut = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    count = Counter(w for d, t in rows if not held(d) for w in cut(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d, held(d), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t)), 4)) for d, t in rows)
    assert sorted((int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()) == want
    assert (got.score < 0).all() and np.isfinite(got.score).all()
    assert lm_score.score_documents(df.limit(0), F.lit(False), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0
    alone = lm_score.score_documents(df.where("doc_id >= 900"), F.lit(True), queries.tokenizer_path("piece_bpe_32k.model")).toPandas()
    assert (alone.n_known == 0).all() and (alone.train_tokens == 0).all() and (alone.score < 0).all()


def small_model(size=40, learn=True):
    rng = np.random.default_rng(0)
    counts, initial = rng.integers(0, 50, size + 1), np.append(rng.random(size) < 0.4, True)
    model = lm_model.Model(counts, initial, rng.random((size + 1, 5)).astype(np.float32))
    if learn:
        trainer = lm_model.Trainer(model)
        trainer.learn(rng.integers(0, size, 3000), rng, 0.1)
        lm_model.apply(model, [(k, lm_model.add([p])) for k, p in trainer.changes(model)])
    return model


def test_model_is_a_distribution():
    m, size = small_model(), 40
    for context in ([], [3], [3, 9, 12], list(np.random.default_rng(3).integers(0, size, 70))):
        total = 0.0
        for nxt in range(size + 1):
            ids = np.array([*context, nxt])
            value = m.log10(ids, [len(ids)]) - (m.log10(np.array(context), [len(context)]) if context else 0)
            total += float(10**value[0])
        assert total == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("initial", [True, False])
def test_pieces_of_one_kind(initial):
    m = lm_model.Model(np.arange(8), np.full(8, initial), np.zeros((8, 3), np.float32))
    assert sum(10 ** m.log10(np.array([k]), [1])[0] for k in range(8)) == pytest.approx(1.0, abs=1e-4)


def test_every_piece_is_scored_once():
    rng, m = np.random.default_rng(1), small_model(30)
    sizes = [1, 2, 31, 32, 33, 56, 57, 200]
    ids = rng.integers(0, 30, sum(sizes))
    together = m.log10(ids, sizes, batch=3)
    at = np.cumsum([0, *sizes])
    apart = [m.log10(ids[a:b], [b - a])[0] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert together == pytest.approx(apart, rel=1e-5)
    # by hand: one window at a time, one position at a time
    w, d, want = m.weights, lm_model.WIDTH, []
    for a, b in zip(at[:-1], at[1:], strict=True):
        doc, read, total = ids[a:b], np.concatenate(([m.end], ids[a : b - 1])), 0.0
        for k in range(len(doc)):
            turn = 0 if k < 32 else -(-(k - 31) // 24)
            x = w["pieces"][read[24 * turn : k + 1]] + w["places"][: k + 1 - 24 * turn]
            att = np.exp(x @ w["key"] @ (x[-1] @ w["query"]) / math.sqrt(d))
            h = x[-1] + att @ (x @ w["value"]) / att.sum()
            h = h + np.maximum(h @ w["wide"] + w["lift"], 0) @ w["narrow"]
            _, _, node, sign = m.tree.ways(doc[k : k + 1])
            total -= np.log1p(np.exp(-sign * (w["nodes"][node, :-1] @ h + w["nodes"][node, -1]))).sum()
        want.append(total / math.log(10))
    assert together == pytest.approx(want, rel=1e-4)


def test_training_lowers_the_loss(monkeypatch):
    """Rounds of training, averaged over two equal trainers, lower the loss."""
    monkeypatch.setattr(lm_model, "BATCH", 4)
    m, rng = small_model(learn=False), np.random.default_rng(5)
    ids = rng.integers(0, 8, 400)
    before = m.log10(ids, [len(ids)])[0]
    for turn in range(20):
        trainer = lm_model.Trainer(m)
        trainer.learn(ids, np.random.default_rng(turn), turn / 20)
        lm_model.apply(m, [(k, lm_model.add([p, p])) for k, p in trainer.changes(m)])
    assert m.log10(ids, [len(ids)])[0] > before + 40


def test_scores_of_null_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (1, ""), (2, "x" * 100_000), (2, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("held_out", F.lit("x"))
    got = lm_score.score_documents(df, F.lit(False), queries.tokenizer_path("piece_bpe_32k.model")).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 2, 4, 4, 50_001] and np.isfinite(got.score).all()
    assert got[got.doc_id.isna()].score.nunique() == 1


def test_held_out_scores_beat_the_base(spark):
    got = queries.op8_lm_score(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


# --- 9 SimHash ---


def brute_fingerprint(text):
    w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes, close):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in close:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def test_masks_cover():
    family = simhash.masks(4).view(np.uint64)
    assert len(family) == 31
    rng = np.random.default_rng(2)
    for _ in range(3000):
        flip = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
        assert any(int(m) & flip == 0 for m in family)


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(120)) for _ in range(8)]
    rows = []
    for k in range(80):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "zz"
        rows.append((k * 3 + 1, " ".join(t).upper() if k % 2 else "\n".join(t)))
    rows += [(500, None), (501, ""), (502, "one"), (502, "one"), (503, "ONE"), (504, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df.unionByName(docs_of(spark, [(None, "lone")], fp="x"), allowMissingColumns=True)).collect() if r.doc_id is not None}
    prints = {d: brute_fingerprint(t) for d, t in rows}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    label = brute_components(prints, close)
    assert got == {d: (prints[d], label[d]) for d in prints}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_runs_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centres for _ in range(120)}
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), k) for k, p in enumerate(sorted(prints))], "fp long, rep long")
    listed = sorted(prints)
    close = [(a, b) for a in range(len(listed)) for b in range(a + 1, len(listed)) if (listed[a] ^ listed[b]).bit_count() <= 4]
    want = brute_components(range(len(listed)), close)
    for run in (8192, 20):
        monkeypatch.setattr(simhash, "RUN", run)
        links = simhash.near_links(nodes)
        got = {r.node: r.component for r in components.connected_components(links).collect()}
        assert {k: got.get(k, k) for k in want} == want
        assert links.count() <= 31 * 4 * len(listed)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (7, 7), (101, 100)] + [(1000, k) for k in range(1001, 1060)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 103), 100), **dict.fromkeys(range(1000, 1060), 1000)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10 fingerprints ---


def test_fingerprints(spark):
    rng = random.Random(10)
    rows = [(rng.randint(-999, 999), "".join(rng.choice("abé 😀\n") for _ in range(rng.choice([0, 1, 2, 31, 32, 33, 700])))) for _ in range(60)] + [(5, None), (5, "z"), (5, "z"), (None, "n" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    got = chunks.fingerprint_neighbours(df, bucket_bytes=2000).collect()
    line = sorted(((-(2**63) if d is None else d), t or "", d) for d, t in rows)
    line.sort(key=lambda r: (-r[0], r[1]))
    want = []
    for k, (_, t, d) in enumerate(line):
        nxt = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = chunks.chunk_sets([t.encode(), edited.encode(), nxt.encode()])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), chunks.as_text(a), chunks.as_text(b), chunks.containment(a, b), chunks.containment(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert chunks.fingerprint_neighbours(df.limit(0)).count() == 0
    alone = chunks.fingerprint_neighbours(docs_of(spark, ["abcd"])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_chunks_resist_shifts():
    rng = random.Random(11)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    a, b, c = chunks.chunk_sets([text, b"inserted" + text[:9000] + b"!" + text[9000:], bytes(reversed(text))])
    assert sum(a.values()) == len(text) and chunks.containment(a, b) > 0.9 and chunks.containment(a, c) < 0.1
    assert all(n <= chunks.MOST for n in a.values()) and chunks.chunk_sets([b"", text])[1] == a


# --- exact set join (pipeline) ---


def brute_alike(texts, size=5, least=0.8):
    """Components over distinct positions of ``texts``, by all pairs."""
    cut = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in map(cut, texts)]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(k) for k in range(len(texts))]


def test_pipeline_finds_all_pairs_by_similarity(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(58)
    texts = [None, "", " ", "one two", "ONE two", "two one"]
    for k in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.choice([6, 20, 60, 250]))]
        common = ["every", "page", "has", "this", "line", "of", "words"] if k % 2 else []
        for _ in range(rng.randrange(1, 14)):
            if rng.random() < 0.3:
                base = base.copy()  # a chain: the next copies start from this one
            new = base.copy() if rng.random() < 0.5 else base
            for _ in range(rng.randrange(1 + len(base) // 40 + 1)):
                new[rng.randrange(len(new))] = str(rng.randrange(10**6))
            texts.append(" ".join(common + new))
    want = brute_alike(texts)
    docs = docs_of(spark, texts, lang="en", source="s", n_chars=1)
    got = {r.doc_id: r.component for r in set_join.with_components(docs).collect()}
    assert len(set(zip((got[k] for k in range(len(texts))), want, strict=True))) == len(set(want)) == len(set(got.values())) < len(texts)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted(set(want))
    assert set_join.with_components(docs.limit(0)).count() == 0


def test_pipeline_judges_rows_by_their_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, "copied text of a row without id"), (None, "copied text of a row without id"), (7, "one text under an id"), (7, "quite another text, same id"), (8, "quite another text, same id"), (9, "copied text of a row without id")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == [rows[2], rows[3], rows[5]]


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_radius_never_decides_the_components(spark, radius):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(words, 60)) for _ in range(6)]
    texts = []
    for k in range(90):
        own = list(base[k % 6])
        for at in rng.integers(0, 60, k % 4):
            own[at] = f"x{k}"
        texts.append(" ".join(own))
    docs, want = docs_of(spark, [*texts, None, "", "one"], lang="en", source="s", n_chars=1), brute_alike([*texts, None, "", "one"])
    got = {r.doc_id: r.component for r in set_join.with_components(docs, radius=radius).collect()}
    assert len(set(zip((got[k] for k in range(len(want))), want, strict=True))) == len(set(want)) == len(set(got.values()))


def test_pipeline_keeps_documents_where_no_language_is_known(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "some words", None, "s", 1), (2, "\u00e9t\u00e9 12", None, "s", 1), (3, "12 !?", None, "s", 1), (4, None, "en", "s", 1), (5, "", None, "s", 1)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


# --- queries and pipeline ---


def test_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        res = con.execute(sql)
        names = [c[0] for c in res.description]
        want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
        assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want, name


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", None, None, 5), (9003, "the and of with", "en", None, 1), (9003, "the and of with", "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = common.settle(stage(spark, docs, SF), name)
        if name != "tokens":
            assert docs.columns == columns
    first, near, clean, mixed = inputs[1:]
    assert first.where("doc_id IN (9001, 9002)").count() == 0 and first.where("doc_id = 9003").count() == 2
    assert near.count() == near.select("doc_id").distinct().count() < first.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    hit = {d for d, _, n, *_ in brute_contaminated([(r.doc_id, r.text) for r in near.collect()], [(r.item_id, r.text) for r in bench]) if n}
    assert {r.doc_id for r in near.collect()} - hit == {r.doc_id for r in clean.collect()} and hit
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies})
    assert docs.count() == mixed.count() and docs.select("start").distinct().count() == docs.count()
