"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is ``width`` consecutive words of an item (an item of fewer words is one window). It
occurs in a document only if all its shingles do, so one of them, its prefix, is enough to
find it. First the benchmark's shingles are counted in all documents, in one aggregated pass;
that orders them by rarity, and every window keeps its rarest one only. Then the documents'
shingles are joined to these prefixes alone, positions bound where the window would start and
end, and the words there are compared exactly. Texts are not shuffled as long as the prefixes
fit a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import ascii_lower, bounded, settle

#: Between words: every ASCII character other than digits and lower-case letters (A-Z are lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, in order; none of a null one."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def _shingled(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """``keep``, pos and token: a hash for each run of ``size`` words of the column words, by start."""
    count = F.greatest(F.size("words") - (size - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice("words", k + 1, count) for k in range(size)))
    exploded = rows.select(*keep, F.posexplode(runs).alias("pos", "run"))
    return exploded.select(*keep, "pos", F.xxhash64(*(F.col("run")[str(k)] for k in range(size))).alias("token"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def windows_of(items: DataFrame, width: int = 10) -> DataFrame:
    """(item_id, window, length): window is its words joined by spaces, which no word contains."""
    words, n = F.col("words"), F.size("words")
    span = F.least(F.lit(width), n)
    starts = F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, span), " "))
    rows = items.select("item_id", words_of(F.col("text")).alias("words")).where(n > 0)
    return rows.select("item_id", F.explode(cut).alias("window"), span.alias("length")).distinct()


def contaminated_by(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``text_hash``.

    n_hit counts the words inside any occurrence of a window of ``items`` (item_id, text), n_items
    the items with such a window; items_sha256 is the SHA-256 of their ids, sorted as strings and
    joined by commas (of nothing if none). Other columns are not read. Null and wordless texts
    have no words and no windows; rows with equal doc_id are judged each by its own text;
    repeated items count by item_id; an empty table on either side hits nothing.
    """
    width, shingle = int(width), min(int(shingle), int(width))
    own = settle(windows_of(items, width), "windows")
    windows = own.select("window", "length").distinct().withColumn("words", F.split("window", " "))
    span = F.least("length", F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(span).distinct().collect())  # at most ``shingle`` of them
    key = ["doc_id", "text_hash"]
    pieces = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    hits = docs.sparkSession.createDataFrame([], docs.select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")).schema)
    if sizes:
        needed = settle(_union([_shingled(windows.where(span == q), q, "window", "length").withColumnRenamed("pos", "offset") for q in sizes]), "tokens")
        tokens = settle(needed.select("token").distinct(), "distinct-tokens")
        counts = _union([_shingled(pieces, q) for q in sizes]).join(bounded(tokens), "token").groupBy("token").agg(F.count("*").alias("n"))
        rarest = needed.join(counts, "token").groupBy("window", "length").agg(F.count("*").alias("found"), F.min(F.struct("n", "token", "offset")).alias("prefix"))
        whole = F.col("found") == F.col("length") - span + 1  # a window with a shingle that no document has is in none
        prefixes = settle(rarest.where(whole).select("window", "length", "prefix.token", "prefix.offset"), "prefixes")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
        same = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ") == F.col("window")
        small = bounded(prefixes)
        found = []
        for q in sizes:
            # beyond the bound, words are joined again to what positions allow, so that they are shuffled once
            kept = ["words"] if small is not prefixes else []
            placed = _shingled(pieces.withColumn("n", F.size("words")), q, *key, "n", *kept).join(small.where(span == q), "token").where(fits)
            placed = placed.select(*key, start.alias("start"), "length", "window", *kept)
            if not kept:
                texts = pieces.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "words").dropDuplicates(["d", "h"])
                placed = placed.distinct().join(texts, F.expr("doc_id <=> d AND text_hash = h"))
            found.append(placed.where(same).select(*key, "start", "length", "window"))
        hits = settle(_union(found).distinct(), "hits")

    # words covered, of places in order; starts and lengths of one text only
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def cover(so_far: Column, p: Column) -> Column:
        stop = p["start"] + p["length"]
        fresh = F.greatest(stop - F.greatest(p["start"], so_far["stop"]), F.lit(0))
        return F.struct(F.greatest(stop, so_far["stop"]).alias("stop"), (so_far["n"] + fresh).alias("n"))

    places = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"))
    covered = places.select(*key, F.aggregate("places", zero, cover)["n"].cast("long").alias("n_hit"))
    named = hits.select(*key, "window").distinct().join(own.select("window", "item_id"), "window").select(*key, F.col("item_id").cast("string").alias("item"))
    lists = named.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    judged = covered.alias("c").join(lists.alias("l"), F.expr("c.doc_id <=> l.doc_id AND c.text_hash = l.text_hash")).select(
        F.col("c.doc_id").alias("d"), F.col("c.text_hash").alias("h"), "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("listed")
    )
    rows = pieces.select(*key, F.size("words").cast("long").alias("n_words"))
    out = rows.join(bounded(settle(judged, "judged")), F.expr("doc_id <=> d AND text_hash = h"), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), "text_hash",
    )
