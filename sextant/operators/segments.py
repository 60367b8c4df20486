"""Sections of statutes as gaps and islands: a table of lines, marks on them, and running sums that gather lines to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators.rows import dealt

# What starts a section, and what a cover, title or marginal line says.
NUMBERED = r"(?sU)^\s*(\d{1,3}[A-Z]?)\.\s*(.*)$"
SCHEDULE_LINE = r"(?iU)^\s*((?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+)?SCHEDULE(?:\s+(?:[IVXLCDM]+|\d+))?)\s*$"
PART_LINE = r"(?U)^\s*((?:PART|Part)\s+[IVXLCDM]+)(?:\s+[A-Z][A-Z0-9\s&,'()/-]*)?\s*$"
CAPITALS = r"(?U)^\s*(?:[A-Z][A-Z0-9\s&,'()/-]*)?$"
COVER = (
    r"(?iU)(parliament of the democratic socialist republic|government printing|department of government printing|printed at|published as a supplement|price\s*:|postage\s*:"
    r"|this act can be downloaded|gazette|ld[-\s]*o|legal supplement)"
)
TITLE_LINE = r"(?iU)\b(act|no\.\s*\d+\s+of\s+\d{4}|certified on|date of certification)\b"
ISSUED = r"(?iU)\b(no\.\s*\d+\s+of\s+\d{4}|certified on|date of certification)\b"
MARGINAL = r"(?iU)\b(short title|amendment|insertion|replacement|repeal|schedule|sinhala|tamil|interpretation|validation|commencement|principal enactment|section)\b"
BODY_TEXT = r"(?iU)^(this act|the provisions|section \d+|in section|for the purposes|where)"


#: What a line takes in the sorts of a task besides its text.
LINE_BYTES = 256


def _clean_heading(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[.;: -]+|[.;: -]+$", ""), F.lit(""))


def _own_heading(rest: Column) -> Column:
    """The first sentence of what follows a section's number, unless it reads like body text or is long."""
    first = X.strip(F.regexp_replace(rest, r"(?sU)(?<=[.;])\s+.*$", ""))
    return F.when(~rest.rlike(BODY_TEXT) & (F.length(first) <= 160), _clean_heading(first))


def _is_marginal(line: Column) -> Column:
    other = line.rlike(COVER) | line.rlike(ISSUED) | line.rlike(NUMBERED) | line.rlike(PART_LINE) | line.rlike(SCHEDULE_LINE)
    return (F.length(line) <= 120) & ~line.endswith(".") & ~other & line.rlike(MARGINAL)


def _is_cover(line: Column) -> Column:
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & ~line.contains("ENACTED")
    return line.rlike(COVER) | ((F.length(line) <= 180) & (line.rlike(TITLE_LINE) | capitals))


def _lines(up: bool = False, before: bool = False) -> WindowSpec:
    """The lines of a document from its start (``up``: from its end) to this one (``before``: the one before it)."""
    order = Window.partitionBy("doc").orderBy(F.col("k").desc() if up else F.col("k"))
    return order.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def _above(value: Column) -> Column:
    """``value`` of the nearest line above that is not blank."""
    return F.last(F.when(~F.col("blank"), value), ignorenulls=True).over(_lines(before=True))


def _below(value: Column) -> Column:
    return F.last(F.when(~F.col("blank"), value), ignorenulls=True).over(_lines(up=True, before=True))


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, k, line, at, ...): the lines of each text with their offsets and what they begin.

    kind: SCHEDULE; before the first of these PART or SECTION. A section number alone on its line takes the next line that is not
    blank as heading, which then begins no section itself: lines that so follow one another alternate.
    """
    texts = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = dealt(texts, "doc", F.octet_length("text") + LINE_BYTES * (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1))
    lines = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    at = F.coalesce(F.sum(F.length("line") + 1).over(_lines(before=True)), F.lit(0)).cast("int")
    own = lines.withColumns({"at": at, "bare": X.strip(F.col("line"))}).withColumns({
        "blank": F.col("bare") == "", "schedule": F.regexp_extract("line", SCHEDULE_LINE, 1), "part": F.regexp_extract("line", PART_LINE, 1),
        "number": F.regexp_extract("line", NUMBERED, 1), "rest": X.strip(F.regexp_extract("line", NUMBERED, 2)),
    })
    alone = (F.col("number") != "") & (F.col("rest") == "")
    marked = own.withColumns({
        "after_alone": F.coalesce(_above(alone), F.lit(False)), "schedules": F.count_if(F.col("schedule") != "").over(_lines()),
        "previous_end": _above(F.col("at") + F.length("line")), "below": _below(F.col("bare")),
    })
    chains = marked.withColumn("chain", F.count_if(~F.col("blank") & ~F.col("after_alone")).over(_lines()))
    taken = F.count_if(~F.col("blank")).over(Window.partitionBy("doc", "chain").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 0
    kind = F.when(F.col("schedule") != "", "SCHEDULE").when(F.col("schedules") > 0, None).when(F.col("part") != "", "PART").when((F.col("number") != "") & ~F.col("taken"), "SECTION")
    kinds = chains.withColumn("taken", taken).withColumn("kind", kind)
    margins = kinds.withColumn("marginal", ~F.col("blank") & F.coalesce(_below(F.coalesce("kind", F.lit(""))) == "SECTION", F.lit(False)) & _is_marginal(F.col("bare")))
    return margins.withColumn("has_margin", F.coalesce(_above(F.col("marginal")), F.lit(False)))


def segment(df: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """One row for each section, part and schedule of each text, and one for what precedes them, in order.

    A section begins at its marginal heading if the line above is one, else behind the line above. What precedes loses its
    cover and title lines; a text without a numbered section is one row. Offsets are of the text as given, in characters. A null
    text counts as empty; keys must be distinct. Texts are shuffled once, by key, to tasks of a fixed size; a document's lines are sorted, not gathered,
    until each block is put together.
    """
    lines = line_table(df, key, text)
    opens = F.col("marginal") | (F.col("kind").isNotNull() & ~F.col("has_margin"))
    doc = Window.partitionBy("doc")
    first = F.min(F.when(~F.col("blank"), F.col("at") + F.length("line") - F.length(X.strip(F.col("line"), right=False)))).over(doc)
    last = F.max(F.when(~F.col("blank"), F.col("at") + F.length(X.strip(F.col("line"), left=False)))).over(doc)
    size = F.max(F.col("at") + F.length("line")).over(doc)
    placed = lines.withColumns({"opens": opens, "first": F.coalesce(first, size), "last": F.coalesce(last, size), "numbered": F.bool_or(F.coalesce(F.col("kind") == "SECTION", F.lit(False))).over(doc)})
    begins = F.when(F.col("marginal") & F.col("previous_end").isNotNull(), F.col("at")).otherwise(F.coalesce(F.col("previous_end") + 1, "first"))
    blocks = placed.withColumn("block", F.when(F.col("numbered"), F.count_if("opens").over(_lines())).otherwise(F.lit(0)))
    in_block = Window.partitionBy("doc", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = F.count_if(~F.col("line").rlike(CAPITALS) & F.col("kind").isNull() | (F.col("schedule") != "")).over(in_block)
    rows = blocks.withColumns({"begins": F.when(F.col("opens"), begins), "titled": stops == 0})

    def joined(which: Column, what: str = "line") -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("k", what)))), lambda x: x[what]), "\n")

    marker = F.struct("kind", F.when(F.col("kind") == "SECTION", F.col("number")).when(F.col("kind") == "PART", F.upper("part")).otherwise(F.col("schedule")).alias("number"),
                      F.when(F.col("kind") == "SECTION", _own_heading(F.when(F.col("rest") != "", F.col("rest")).otherwise(F.coalesce("below", F.lit(""))))).otherwise(F.col("schedule")).alias("heading"))
    found = rows.groupBy("doc", "block").agg(
        joined(F.lit(True)).alias("whole"), joined((F.col("block") == 0) & ~_is_cover(F.col("bare")), "bare").alias("kept"), joined(F.col("titled"), "bare").alias("title"),
        F.max(F.when(F.col("kind").isNotNull(), marker)).alias("marker"), F.max(F.when(F.col("marginal"), _clean_heading(F.col("bare")))).alias("margin"), F.min("begins").alias("begins"),
        F.first("numbered").alias("numbered"), F.first("first").alias("first"), F.first("last").alias("last"),
    )
    kept = X.strip(F.regexp_replace("kept", r"\n{2,}", "\n\n"))
    start = F.when(F.col("block") == 0, F.col("first")).otherwise(F.col("begins"))
    ends = F.coalesce(F.lead("begins").over(Window.partitionBy("doc").orderBy("block")), "last")
    out = found.withColumns({"source_start": start, "source_end": ends, "kept": kept}).where(~((F.col("block") == 0) & F.col("numbered") & (F.col("kept") == "")))
    number = F.when(~F.col("numbered"), "0").when(F.col("block") == 0, "PREAMBLE").otherwise(F.col("marker.number"))
    heading = F.when(~F.col("numbered"), "Document text").when(F.col("block") == 0, "Preamble").when(F.col("marker.kind") == "PART", X.strip(F.col("title"))).otherwise(F.coalesce("marker.heading", "margin"))
    body = F.when((F.col("block") == 0) & (F.col("kept") != ""), F.col("kept")).otherwise(X.strip(F.col("whole")))
    named = out.select(
        F.col("doc").alias(key), (F.row_number().over(Window.partitionBy("doc").orderBy("block")) - 1).alias("position"), number.alias("section_number"), number.alias("section_path"), heading.alias("heading"),
        F.when(~F.col("numbered"), "OTHER").when(F.col("block") == 0, "PREAMBLE").otherwise(F.col("marker.kind")).alias("section_type"), body.alias("text"), "source_start", "source_end",
    )
    return named.select(key, "position", "section_number", "section_path", "heading", "section_type", "text", X.search_form(F.col("text")).alias("normalized_text"), F.col("position").alias("sort_order"), "source_start", "source_end")


def summary(sections: DataFrame, key: str = "id") -> DataFrame:
    """Per text: sections, schedules and parts, whether it fell back on one row, and whether a preamble was kept."""
    of = lambda kind: F.count_if(F.col("section_type") == kind)
    return sections.groupBy(key).agg(of("SECTION").alias("sections_detected"), of("SCHEDULE").alias("schedules_detected"), of("PART").alias("parts_detected"), (of("OTHER") > 0).alias("fallback_used"), (of("PREAMBLE") > 0).alias("preamble_kept"))
