"""Resolving references to acts and sections with joins and windows, in one plan.

The sequential rule (a bare operative reference means the act last cited before it) is an as-of
window: see ``resolve_context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import scoring as M
from sextant.functions import text as X
from sextant.operators import fuzzy
from sextant.sources.storage import settle

OPERATIVE = ("AMENDS", "REPEALS", "INSERTS", "SUBSTITUTES", "ADDS")
LEAST_SCORE, LEAST_MARGIN = 0.5, 0.15


#: What a reference says of its target in words.
SAID = ("target_act_title_raw", "raw_reference_text")


def read_texts(references: DataFrame) -> DataFrame:
    """Each distinct pair of cited title and raw text once, with what it names: said_number, said_year, said_chapter,
    title_form, and wanted, the title forms to look for in order.

    Names found by pattern are ASCII; only whole titles are composed.
    """
    title, raw = F.col(SAID[0]), F.col(SAID[1])
    name = lambda c: X.act_title_form(X.cited_name(c), compose=False)
    texts = references.select(*SAID).distinct().withColumns({"title_form": X.act_title_form(title), "of_title": X.citation(title), "of_raw": X.citation(raw)})
    wanted = F.array_distinct(F.filter(F.array(name(title), name(raw), F.col("title_form")), lambda f: f != ""))
    said = {"said_number": F.coalesce("of_title.number", "of_raw.number"), "said_year": F.coalesce("of_title.year", "of_raw.year"), "said_chapter": X.chapter(title), "wanted": wanted}
    return texts.withColumns(said).drop("of_title", "of_raw")


#: Length of the pieces of titles that containment is joined on.
GRAM = 4


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda k: F.substr(text, k, F.lit(GRAM))))


def containing_titles(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """(wanted, title, ...) of every title that contains a wanted text of 4 characters or more, both frames having each text once.

    A title that contains a text has all of its pieces of 4 characters, so each text is joined on the one
    that fewest titles have, not on a common word, and not at all if one of its pieces is in no title.
    The pieces are many times the titles that they come from, by whose size Spark would broadcast them, so both joins are merged.
    """
    postings = titles.where(F.length("title") >= GRAM).select(*titles.columns, F.explode(_grams(F.col("title"))).alias("gram"))
    rarity = postings.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = wanted.where(F.length("wanted") >= GRAM).select("wanted", F.explode(_grams(F.col("wanted"))).alias("gram")).join(rarity.hint("merge"), "gram", "left")
    rarest = pieces.groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").drop("all")
    return rarest.join(postings.hint("merge"), "gram").where((F.length("title") >= F.length("wanted")) & F.col("title").contains(F.col("wanted"))).drop("gram")


def resolve_titles(wanted: DataFrame, acts: DataFrame) -> DataFrame:
    """(wanted, act, kind) of each distinct wanted title that is found: exact, the least act of the title; else partial, the act
    whose title contains it, is similar enough and clearly the best. Found but unclear, act is null. Distinct titles are settled."""
    titles = settle(acts.where("normalized_title <> ''").groupBy(F.col("normalized_title").alias("title")).agg(F.min("id").alias("act"), F.count("*").alias("holders")), "titles")
    both = wanted.join(titles, F.col("wanted") == F.col("title"), "left")
    exact = both.where("act IS NOT NULL").select("wanted", "act", F.lit("exact").alias("kind"))
    near = containing_titles(both.where("act IS NULL").select("wanted"), titles)
    best = fuzzy.best_match(near.withColumn("text", F.col("wanted")), ["wanted"], "text", "title", "act", LEAST_SCORE, LEAST_MARGIN, copies="holders")
    return settle(exact.unionByName(best.select("wanted", F.when(F.col("sure"), F.col("act")).alias("act"), F.lit("partial").alias("kind"))), "resolved")


def chapter_places(acts: DataFrame) -> DataFrame:
    """(place, act): every chapter named in an act's title, source or address, the least act of each.

    A chapter is found inside longer text, so "chapter 212a" also stands for chapters 21 and 2.
    """
    sources = [c for c in ("normalized_title", "source_name", "source_url") if c in acts.columns]
    found = F.flatten(F.array(*(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"chapter (\d+[a-z]?)"), F.lit(1)) for c in sources)))
    numbers = acts.select(F.col("id").alias("act"), F.explode(F.array_distinct(found)).alias("number"))
    starts = numbers.select("act", F.explode(F.transform(F.sequence(F.lit(1), F.length("number")), lambda k: F.substr("number", F.lit(1), k))).alias("start"))
    return starts.groupBy(F.concat(F.lit("chapter "), "start").alias("place")).agg(F.min("act").alias("by_chapter"))


def acts_by_number(acts: DataFrame) -> DataFrame:
    """(act_number, year, by_number): the least act of each."""
    return acts.groupBy("act_number", "year").agg(F.min("id").alias("by_number"))


def own_target(references: DataFrame, acts: DataFrame) -> DataFrame:
    """Add ``own`` and ``match``, the act that a reference names itself, and title_form; number and year are filled from what it says.

    By number and year if it has both (and nothing else then); else by titles in order, exact before
    partial for each; else by chapter in an act's title or source. Of equal acts the least id. Each distinct
    text is read, and each distinct title resolved, once; references are joined to what was found.
    """
    texts = settle(read_texts(references), "said")
    found, titled = resolve_titles(texts.select(F.explode("wanted").alias("wanted")).distinct(), acts), texts
    for k in range(3):
        one = found.select(F.col("wanted").alias("_wanted"), F.struct("act", "kind").alias(f"_{k}"))
        titled = titled.join(one, F.get("wanted", F.lit(k)) == F.col("_wanted"), "left").drop("_wanted")
    titled = titled.withColumn("titled", F.coalesce("_0", "_1", "_2")).drop("wanted", "_0", "_1", "_2")
    out = references.join(titled.withColumnsRenamed({c: f"_{c}" for c in SAID}), F.col(SAID[0]).eqNullSafe(F.col(f"_{SAID[0]}")) & F.col(SAID[1]).eqNullSafe(F.col(f"_{SAID[1]}")), "left").drop(*(f"_{c}" for c in SAID))
    out = out.withColumns({"target_act_number": X.act_number(F.coalesce("target_act_number", "said_number")), "target_act_year": F.coalesce("target_act_year", "said_year")})
    out = out.join(acts_by_number(acts), (F.col("target_act_number") == F.col("act_number")) & (F.col("target_act_year") == F.col("year")), "left").drop("act_number", "year")
    chapter = F.lower(F.coalesce("said_chapter", X.chapter(F.col("target_section_path"))))
    out = out.withColumn("_chapter", chapter).join(chapter_places(acts), F.col("_chapter") == F.col("place"), "left").drop("_chapter", "place")
    cites = F.col("target_act_number").isNotNull() & F.col("target_act_year").isNotNull()
    own = F.when(cites, F.col("by_number")).when(F.col("titled").isNotNull(), F.col("titled.act")).otherwise(F.col("by_chapter"))
    match = F.when(own.isNull(), F.lit(None)).when(cites, "exact").when(F.col("titled").isNotNull(), F.col("titled.kind")).otherwise("partial")
    return out.withColumns({"own": own, "match": match}).drop("by_number", "titled", "by_chapter", "said_number", "said_year", "said_chapter")


def resolve_context(rows: DataFrame, act: str, *order: str, own: str = "own", principal: str = "principal", bare: str = "bare", locked: str | None = None) -> DataFrame:
    """Add ``context`` and ``resolved``: bare and principal-enactment references take the act last cited before.

    A citation becomes the context if it has an act of its own, does not say "principal enactment",
    and is locked, not bare, or the first such in its document.
    """
    held = F.col(locked) if locked else F.lit(False)
    place = Window.partitionBy(act).orderBy(*order)
    names = F.col(own).isNotNull() & ~F.col(principal)
    seen = F.count_if(names).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    anchor = F.when(names & (held | ~F.col(bare) | (F.col("_seen") == 1)), F.col(own))
    context = F.last("_anchor", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    resolved = F.when(held, F.col(own)).when((F.col(principal) | F.col(bare)) & F.col("context").isNotNull(), F.col("context")).otherwise(F.col(own))
    return rows.withColumn("_seen", seen).withColumn("_anchor", anchor).withColumn("context", context).withColumn("resolved", resolved).drop("_seen", "_anchor")


def map_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Add ``section``: of the resolved act, by number, else path, else the schedule that names the path."""
    s = sections.select(F.col("id").alias("_sid"), F.col("act_id").alias("_act"), "section_number", "section_path", "section_type", F.concat_ws("\n", "section_path", "heading", "text").alias("_all"))
    numbers = s.groupBy("_act", F.col("section_number").alias("_key")).agg(F.min("_sid").alias("by_number"))
    paths = s.groupBy("_act", F.col("section_path").alias("_key")).agg(F.min("_sid").alias("by_path"))
    out = rows.join(numbers, (F.col("resolved") == F.col("_act")) & (F.col("target_section_number") == F.col("_key")), "left").drop("_act", "_key")
    out = out.join(paths, (F.col("resolved") == F.col("_act")) & (F.col("target_section_path") == F.col("_key")), "left").drop("_act", "_key")
    wanted = out.select("resolved", X.schedule(F.col("target_section_path")).alias("_path")).where("resolved IS NOT NULL AND _path IS NOT NULL").distinct()
    schedules = s.where("section_type = 'SCHEDULE'").join(wanted, F.col("_act") == F.col("resolved")).where(F.lower("_all").contains(F.lower("_path")))
    schedules = schedules.groupBy("_act", "_path").agg(F.min("_sid").alias("by_schedule"))
    out = out.withColumn("_want", X.schedule(F.col("target_section_path"))).join(schedules, (F.col("resolved") == F.col("_act")) & (F.col("_want") == F.col("_path")), "left")
    return out.withColumn("section", F.coalesce("by_number", "by_path", "by_schedule")).drop("by_number", "by_path", "by_schedule", "_act", "_path", "_want")


def map_references(references: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Resolve every reference of every act; VERIFIED and REJECTED ones stay as they are but give context.

    Adds resolved, section, match, confidence, needs_review, used_context. ``references`` needs a
    ``position`` that orders an act's references as in its text.
    """
    locked = F.col("verification_status").isin("VERIFIED", "REJECTED")
    rows = own_target(references, acts)
    rows = rows.withColumns({"locked": locked, "own": F.when(locked, F.col("target_act_id")).otherwise(F.col("own")), "principal": F.col("title_form") == "principal enactment"})
    named = F.coalesce("target_act_id", "target_act_number", "target_act_title_raw").isNotNull()
    bare = ~named & F.coalesce("target_section_number", "target_section_path").isNotNull() & F.col("relationship_type").isin(*OPERATIVE)
    rows = resolve_context(rows.withColumn("bare", bare), "source_act_id", "position", locked="locked")
    used = ~F.col("locked") & (F.col("principal") | F.col("bare")) & F.col("context").isNotNull()
    rows = map_sections(rows.withColumns({"used_context": used, "match": F.when(used, "inferred").otherwise(F.col("match"))}), sections)
    target = F.coalesce("target_act_title_raw", "target_act_number", "target_section_number", "target_section_path").isNotNull()
    confidence = M.mapping_confidence(F.when(F.col("resolved").isNotNull(), F.col("match")), F.when(F.col("resolved").isNotNull(), F.col("section").isNotNull()).otherwise(target))
    return rows.withColumns({"confidence": confidence, "needs_review": F.col("resolved").isNull() | (confidence < 0.85)}).drop("principal", "bare", "own", "title_form")


def context_preview(mapped: DataFrame) -> DataFrame:
    """(source_act_id, act, cited): per act its first reference in order that names an act itself and does not say "principal enactment".

    ``mapped``: source_act_id, position, own, principal, raw_reference_text; acts without one have no row.
    """
    named = mapped.where(F.col("own").isNotNull() & ~F.coalesce("principal", F.lit(False)))
    first = F.min_by(F.struct(F.col("own").alias("act"), F.col("raw_reference_text").alias("cited")), "position")
    return named.groupBy("source_act_id").agg(first.alias("_first")).select("source_act_id", "_first.act", "_first.cited")


def mapping_summary(mapped: DataFrame) -> DataFrame:
    band = F.when(F.col("resolved").isNull(), "unresolved").otherwise(F.col("match"))
    return mapped.agg(
        F.count_if(F.col("resolved").isNotNull()).alias("mapped_acts"), F.count_if(F.col("section").isNotNull()).alias("mapped_sections"), F.count_if(F.col("resolved").isNull()).alias("unresolved"),
        F.count_if("used_context").alias("context_used"), *(F.count_if(band == b).alias(b) for b in ("exact", "partial", "inferred")),
    )
