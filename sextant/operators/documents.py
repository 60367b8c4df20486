"""Documents and their extractions: metadata, pages, merging and choosing among extractions.

Sections are in ``segments``, references in ``citations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions.scoring import metadata_confidence
from sextant.operators.rows import dealt

#: Bytes of text whose metadata one task finds, and what a text takes besides its own.
TASK_BYTES, TEXT_BYTES = 2 << 20, 256


def metadata(df: DataFrame, key: str = "id", text: str = "raw_text", file_name: str = "source_file_name") -> DataFrame:
    """Title, number, year and dates near the start of each text; the title by its first act-like line, else the file's name.

    Starts of texts (and their first 40 lines) are dealt by key to tasks of a fixed size; line and title are columns of their own, so that each is found once.
    """
    starts = df.select(key, F.substring(text, 1, 8000).alias("_start"), F.substring_index(text, "\n", 40).alias("_lines_of"), F.col(file_name).alias("_file"))
    starts = dealt(starts, key, F.coalesce(F.octet_length("_start") + F.octet_length("_lines_of"), F.lit(0)) + TEXT_BYTES, TASK_BYTES)
    start = F.col("_start")
    day = r"(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{4})"
    date = lambda *names: F.coalesce(*(X.loose_date(X.found(start, rf"(?i)\b{n}\s*{day}")) for n in names))
    lines = F.filter(F.transform(F.slice(F.split(F.col("_lines_of"), "\n"), 1, 40), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i),?\s*No\.?\s*\d+[A-Za-z]?\s+of\s+\d{4}\b", ""), r"^[ ,:;-]+|[ ,:;-]+$", "")
    noise = r"(?i)\b(parliament|democratic socialist republic|sri lanka|gazette|printed|published|arrangement of sections|certified on|date of certification|supplement|can be downloaded|documents\.gov\.lk)\b"
    # no bare line says "act" whose line does not
    fits = lambda x: x.rlike("(?i)act|ordinance") & (F.length(bare(x)) >= 8) & (F.length(bare(x)) < 160) & bare(x).rlike(r"(?i)\b(act|ordinance)\b") & ~x.rlike(noise)
    line = F.try_element_at(F.filter(lines, fits), F.lit(1))
    stem = F.regexp_replace(F.regexp_replace(F.col("_file"), r"\.[^.]*$", ""), "_", " ")
    found = starts.withColumn("_line", line).withColumn("_title", F.coalesce(bare(F.col("_line")), stem))
    title, line = F.col("_title"), F.col("_line")
    found = found.withColumn("_cased", F.when(F.upper(title) == title, F.initcap(title)).otherwise(title))
    cased = F.col("_cased")
    number = X.found(start, r"(?i)\b(?:Act\s*,?\s*)?No\.?\s*(\d+[A-Za-z]?)\s+of\s+\d{4}\b")
    certified = date(r"Certified\s+on", r"Date\s+of\s+Certification\s*:?")
    return found.select(
        key, cased.alias("title"), X.search_form(title).alias("normalized_title"), number.alias("act_number"), X.found(start, r"(?i)\bNo\.?\s*\d+[A-Za-z]?\s+of\s+(\d{4})\b").cast("int").alias("year"),
        certified.alias("certification_date"), date(r"Published\s+on", r"Date\s+of\s+Publication\s*:?", r"Publication\s+Date\s*:?").alias("publication_date"),
        metadata_confidence(F.when(line.isNotNull(), 0.9).otherwise(0.35), number.isNotNull(), certified.isNotNull()).alias("confidence"),
    )


def section_pages(sections: DataFrame, spans: DataFrame, act: str = "id") -> DataFrame:
    """page_start and page_end of sections (source_start, source_end): the first and last page of their document (page_number, start, end) that they overlap.

    Pages must not overlap one another and be numbered in order, as ``page_spans`` makes them; empty pages
    overlap nothing, and a section that none overlaps has null. One shuffle by document, then two sweeps over its pages and
    sections together, linear in both: forwards the last page that starts before a section ends, backwards the first that ends after it starts.
    """
    page = F.struct(F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.col("page_number").alias("n"))
    pages = spans.where("start < end").select(F.col(act).alias("_doc"), page.alias("_page"))
    rows = sections.select(F.col(act).alias("_doc"), F.col("source_start").cast("long").alias("_a"), F.col("source_end").cast("long").alias("_b"), F.struct(*sections.columns).alias("_row"))
    events = rows.unionByName(pages, allowMissingColumns=True)
    by_doc, is_page = Window.partitionBy("_doc"), F.col("_page").isNotNull()
    forwards = by_doc.orderBy(F.coalesce("_page.a", "_b"), is_page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backwards = by_doc.orderBy(F.coalesce("_page.b", "_a").desc(), is_page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumns({"_last": F.last("_page", ignorenulls=True).over(forwards), "_first": F.last("_page", ignorenulls=True).over(backwards)}).where("_row IS NOT NULL")
    over = (F.col("_first.a") < F.col("_b")) & (F.col("_last.b") > F.col("_a"))
    pages_of = (F.when(over, F.col(f"{side}.n")).alias(name) for name, side in (("page_start", "_first"), ("page_end", "_last")))
    return swept.select(*(F.col("_row").getField(c).alias(c) for c in sections.columns), *pages_of)


def page_spans(pages: DataFrame, act: str = "id", separator: int = 2) -> DataFrame:
    """Where each cleaned page lies in its document's text, pages joined by ``separator`` characters."""
    before = Window.partitionBy(act).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def rebased_spans(spans: DataFrame, act: str = "id") -> DataFrame:
    """Spans in the text without the white space around it: moved by what is cut in front, clipped to what is left.

    ``spans`` as from ``page_spans``. What lies in front is found from the pages: all of the blank ones before the first
    other, their separators, and that page's own leading space; likewise behind.
    """
    spaces = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    blank = F.col("text").rlike(r"(?U)^\s*$")
    by_doc = Window.partitionBy(act)
    first = F.min(F.when(~blank, F.col("start") + spaces(r"(?U)^\s+"))).over(by_doc)
    last = F.max(F.when(~blank, F.col("end") - spaces(r"(?U)\s+$"))).over(by_doc)
    clipped = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.coalesce("_to", F.lit(0))) - F.coalesce("_from", F.lit(0)))
    return spans.withColumns({"_from": first, "_to": last}).withColumns({"start": clipped("start"), "end": clipped("end")}).drop("_from", "_to")


def merge_extractions(regex: DataFrame, model: DataFrame, key: str = "reference_key") -> DataFrame:
    """References found by patterns and by a model: agreement raises confidence by 0.1 (0.98 at most); the model alone needs 0.5."""
    a, b = regex.alias("a"), model.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    agreed = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    score = F.when(agreed, F.least(F.col("a.confidence_score") + 0.1, F.lit(0.98))).otherwise(F.coalesce("a.confidence_score", "b.confidence_score"))
    method = F.when(F.col(f"b.{key}").isNotNull(), "LLM").otherwise(F.col("a.extraction_method"))
    rest = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in regex.columns if c not in ("confidence_score", "extraction_method", "verification_status")]
    status = F.when(F.col(f"a.{key}").isNull(), "NEEDS_REVIEW").otherwise(F.col("a.verification_status"))
    out = both.select(*rest, F.round(score, 4).alias("confidence_score"), method.alias("extraction_method"), status.alias("verification_status"), F.col(f"a.{key}").isNull().alias("_alone"))
    return out.where(~F.col("_alone") | (F.col("confidence_score") >= 0.5)).drop("_alone")


def better_source(candidates: DataFrame, doc: str = "id") -> DataFrame:
    """Of several extractions of a document the first by ``preference`` without errors, else the baseline (``is_baseline``)."""
    order = Window.partitionBy(doc).orderBy((F.size("errors") > 0), F.when(F.size("errors") > 0, ~F.col("is_baseline")), "preference")
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def has_sparse_page(pages: Column, least: int = 20) -> Column:
    """Whether a page of an extraction, an array of texts, has fewer than ``least`` characters without the space around it: its native text is then not enough."""
    return F.exists(pages, lambda p: F.length(X.strip(F.coalesce(p, F.lit("")))) < least)


def native_first(candidates: DataFrame, doc: str = "id") -> DataFrame:
    """Of each document's extractions the native one if none of its pages is sparse and it passes the gate, else as ``better_source`` chooses.

    ``candidates``: preference, errors, is_baseline, is_native, pages.
    """
    sparse = F.col("is_native") & has_sparse_page(F.col("pages"))
    judged = candidates.withColumn("errors", F.when(sparse, F.array_append("errors", F.lit("sparse_pages"))).otherwise(F.col("errors")))
    first = F.when(F.col("is_native"), F.lit(-1)).otherwise(F.col("preference"))
    return better_source(judged.withColumns({"_given": F.col("preference"), "preference": first}), doc).withColumn("preference", F.col("_given")).drop("_given")


def quality_errors(chars: Column, pages: Column, sections: Column, base_sections: Column, spans: Column, base_spans: Column) -> Column:
    """Which of the gate's demands an extraction misses."""
    least = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(pages / 20)))
    checks = (
        (chars < 40 * pages, "text_density"), (sections < least, "sections"), (sections < 0.8 * base_sections, "fewer_sections"), (spans < 0.8 * base_spans, "fewer_citations"),
    )
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in checks)), lambda x: x.isNotNull())
