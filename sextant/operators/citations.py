"""References in statute text as relations: a table of match offsets by pattern, sentence bounds by a sweep, containment by a running maximum."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import scoring as M
from sextant.functions import text as X
from sextant.operators.rows import dealt

# The patterns in the order of their passes, with the names of their groups.
PATTERNS = {
    "AMENDING_ACT": (r"\bAn\s+Act\s+(?:to\s+)?Amend\s+(?:the\s+)?([A-Z][A-Za-z0-9\s,&.'()/-]{3,160}?(?:Act|Ordinance))(?:,?\s+No\.?\s*(\d+)\s+of\s+(\d{4}))?(?:\s*\((Chapter\s+\d+[A-Z]?)\))?", "title number year chapter"),
    "SECTION_OF_ACT_AMENDED": (r"\bSection\s+(\d+[A-Z]*)\s+of\s+the\s+([A-Z][A-Za-z0-9\s,&.'()/-]{3,160}?\s+Act),?\s+No\.?\s*(\d+)\s+of\s+(\d{4})(.{0,120}?\bis\s+hereby\s+amended\b)", "section title number year trailing"),
    "PRINCIPAL_SECTION_AMENDED": (r"\bSection\s+(\d+[A-Z]*)\s+of\s+the\s+principal\s+enactment(.{0,120}?\bis\s+hereby\s+amended\b)", "section trailing"),
    "NEW_SECTION_INSERT": (r"\bfollowing\s+new\s+section\s+is\s+hereby\s+inserted\s+immediately\s+after\s+section\s+(\d+[A-Z]*)(.{0,500}?\bshall\s+have\s+effect\s+as\s+section\s+(\d+[A-Z]*))", "after trailing section"),
    "EFFECT_AS_SECTION": (r"\bshall\s+have\s+effect\s+as\s+section\s+(\d+[A-Z]*)", "section"),
    "REPEAL_PARAGRAPH": (r"\bby\s+the\s+repeal\s+of\s+paragraph\s+\(([a-z])\)\s+of\s+subsection\s+\((\d+[A-Z]?)\)", "paragraph subsection"),
    "SUBSTITUTION": (r"\b(?:by\s+the\s+substitution\s+for|substitution\s+therefor|substituted\s+therefor)(.{0,180})", "trailing"),
    "ADDITION": (r"\b(?:by\s+the\s+addition\s+immediately\s+after|addition\s+immediately\s+after)\s+(paragraph|item|section)\s+((?:\([a-z0-9]+\)|\d+[A-Z]*))(.{0,180})", "target_type target trailing"),
    "NEW_PARAGRAPH_ITEM": (r"\bof\s+the\s+following\s+new\s+(paragraph|item)\b(.{0,180})", "target_type trailing"),
    "SCHEDULE_AMENDMENT": (r"\bThe\s+((?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth)\s+Schedule)\s+to\s+the\s+principal\s+enactment(.{0,120}?\bis\s+hereby\s+amended\b)", "schedule trailing"),
    "ACT_CITATION": (r"([A-Z][A-Za-z0-9\s,&.'()/-]{3,120}?)\s+Act,?\s+No\.?\s*(\d+)\s+of\s+(\d{4})", "title number year"),
    "SECTION": (r"\b(?:section|sections|s\.|sec\.)\s+(\d+[A-Z]*(?:\([^)]+\))?)", "section"),
    "SUBSECTION": (r"\bsubsection\s+\((\d+[A-Z]*)\)", "subsection"),
    "PARAGRAPH": (r"\bparagraph\s+\(([a-z])\)", "paragraph"),
    "ITEM": (r"\bitem\s+(\d+[A-Z]*)\b", "item"),
    "SCHEDULE": (r"\b((?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth)?\s*Schedule\s*[IVXLCDM]*)\b", "schedule"),
    "CHAPTER": (r"\bChapter\s+(\d+[A-Z]?)\b", "chapter"),
}
#: What a match of each pattern says: relationship (none: by its sentence), title, section, path.
SAYS = {
    "AMENDING_ACT": ("AMENDS", "{title}", "", "{chapter}"), "SECTION_OF_ACT_AMENDED": ("AMENDS", "{title}", "{section}", "{section}"), "PRINCIPAL_SECTION_AMENDED": ("AMENDS", "principal enactment", "{section}", "{section}"),
    "NEW_SECTION_INSERT": ("INSERTS", "", "{section}", "after section {after}; section {section}"), "EFFECT_AS_SECTION": ("INSERTS", "", "{section}", "{section}"),
    "REPEAL_PARAGRAPH": ("REPEALS", "", "({paragraph})", "subsection ({subsection}) paragraph ({paragraph})"), "SUBSTITUTION": ("SUBSTITUTES", "", "", ""), "ADDITION": ("ADDS", "", "{target}", "{target_type} {target}"),
    "NEW_PARAGRAPH_ITEM": ("ADDS", "", "", "new {target_type}"), "SCHEDULE_AMENDMENT": ("AMENDS", "principal enactment", "", "{schedule}"), "ACT_CITATION": (None, "{title} Act", "", ""),
    "SECTION": (None, "", "{section}", "{section}"), "SUBSECTION": (None, "", "({subsection})", "({subsection})"), "PARAGRAPH": (None, "", "({paragraph})", "({paragraph})"), "ITEM": (None, "", "{item}", "item {item}"),
    "SCHEDULE": (None, "", "", "{schedule}"), "CHAPTER": (None, "Chapter {chapter}", "", ""),
}
#: The passes from this one on are weak: a match inside a strong one does not count. Those of GATED also need a phrase that relates.
FIRST_WEAK = "SECTION"
GATED = ("SECTION", "SUBSECTION", "PARAGRAPH", "ITEM")
CONTEXT = 160
#: Stands for a match while a text is split; no character of its own.
MARK = "\uffff"
#: What a text must hold for a pattern that is tried at every letter.
NEEDED = {"ACT_CITATION": r"(?iU)\sAct,?\s+No\.?\s*\d+\s+of\s+\d{4}"}
#: Letters, one of which a text of ASCII must hold, in either case, for a pattern to match.
HOLDS = {
    "AMENDING_ACT": ("amend",), "SECTION_OF_ACT_AMENDED": ("hereby",), "PRINCIPAL_SECTION_AMENDED": ("principal",), "NEW_SECTION_INSERT": ("inserted",), "EFFECT_AS_SECTION": ("effect",), "REPEAL_PARAGRAPH": ("repeal",),
    "SUBSTITUTION": ("substitut",), "ADDITION": ("addition",), "NEW_PARAGRAPH_ITEM": ("following",), "SCHEDULE_AMENDMENT": ("principal",), "ACT_CITATION": ("act",), "SECTION": ("sec", "s."), "SUBSECTION": ("subsection",),
    "PARAGRAPH": ("paragraph",), "ITEM": ("item",), "SCHEDULE": ("schedule",), "CHAPTER": ("chapter",),
}
NAMES = list(PATTERNS)
#: Bytes of text that go to one task, and what a text takes besides its own: patterns take their time.
TASK_BYTES, TEXT_BYTES = 2 << 20, 256


def _regex(name: str) -> str:
    return f"(?isU){PATTERNS[name][0]}"


def match_offsets(texts: DataFrame) -> DataFrame:
    """(doc, pass, raw, start, stop) of every match in ``texts`` (doc, text), in bytes.

    One pass of a pattern puts marks around its matches, so that a split at these gives them and the gaps in turn, and a match
    starts at the sum of what precedes it. A text that holds the mark itself is split by the pattern.
    """

    def found(number: int, name: str) -> Column:
        text, regex = F.col("text"), _regex(name)
        # a split compiles its pattern for every text, a replacement once
        marked = F.split(F.regexp_replace(text, regex, f"{MARK}$0{MARK}"), MARK, -1)
        split = F.flatten(F.transform(F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("raw")), lambda x: F.array(x["gap"], F.coalesce(x["raw"], F.lit("")))))
        able = F.length(text) < F.octet_length(text)
        for letters in HOLDS[name]:
            able = able | F.col("low").contains(letters)
        if name in NEEDED:
            able = able & text.rlike(NEEDED[name])
        return F.struct(F.lit(number).alias("pass"), F.when(able, F.when(text.contains(MARK), F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(marked)).alias("parts"))

    parts = texts.withColumn("low", F.lower("text")).select("doc", F.explode(F.array(*(found(k, name) for k, name in enumerate(NAMES)))).alias("m")).select("doc", "m.*").where(F.size("parts") > 1)
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.get("parts", 2 * i + 1).alias("raw"), F.octet_length(F.get("parts", 2 * i)).alias("gap")))
    rows = parts.select("doc", "pass", F.explode(each).alias("m")).select("doc", "pass", "m.*")
    upto = F.sum(F.col("gap") + F.octet_length("raw")).over(Window.partitionBy("doc", "pass").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return rows.withColumn("stop", upto).select("doc", "pass", "raw", (F.col("stop") - F.octet_length("raw")).alias("start"), "stop")


def _bounded(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """Add left and right: where the clause of each match begins and ends, by the nearest full stop, semicolon or line feed on either side."""
    parts = F.transform(F.split("text", "[.;\n]", -1), F.octet_length)
    pieces = texts.select("doc", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("i", "size"))
    upto = F.sum(F.col("size") + 1).over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    marks = pieces.withColumn("mark", upto - 1).select("doc", "mark")
    events = matches.unionByName(marks, allowMissingColumns=True)
    is_mark, doc = F.col("mark").isNotNull(), Window.partitionBy("doc")
    near = lambda order: F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left, right = near(doc.orderBy(F.coalesce("mark", "start"), is_mark)), near(doc.orderBy(F.coalesce("mark", "stop").desc(), ~is_mark))
    return events.withColumns({"left": F.coalesce(left + 1, F.lit(0)), "right": right + 1}).where("pass IS NOT NULL").drop("mark")


def _cut(raw: Column, a: Column, b: Column) -> Column:
    return F.substr(raw, a + 1, b - a).cast("string")


def _in_context(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """Add sentence and context (``CONTEXT`` characters on each side), cut from the bytes of each text, which meets its matches once."""
    gathered = matches.groupBy("doc").agg(F.collect_list(F.struct("pass", "raw", "start", "stop", "left", "right")).alias("all"))
    one = texts.select(F.col("doc").alias("_doc"), F.col("text").cast("binary").alias("_raw"))
    both = gathered.join(one, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "_raw", F.explode("all").alias("m"))
    raw, wide = F.col("_raw"), 4 * CONTEXT + 4
    before = F.right(_cut(raw, F.greatest(F.col("m.start") - wide, F.lit(0)), F.col("m.start")), F.lit(CONTEXT))
    after = F.left(_cut(raw, F.col("m.stop"), F.col("m.stop") + wide), F.lit(CONTEXT))
    sentence = _cut(raw, F.col("m.left"), F.coalesce("m.right", F.octet_length(raw)))
    return both.select("doc", "m.pass", "m.raw", "m.start", "m.stop", X.squeeze(sentence).alias("sentence"), X.squeeze(F.concat(before, F.col("m.raw"), after)).alias("context_snippet"))


def first_wordings(matches: DataFrame) -> DataFrame:
    """Of each doc's matches those that count: of one wording the first by pass and place, and of the weak none inside a strong one that counts.

    ``matches``: doc, pass, start, stop, key, passes (whether its sentence lets it count).
    """
    weak, order = F.col("pass") >= NAMES.index(FIRST_WEAK), Window.partitionBy("doc", "key").orderBy("pass", "start")
    strong_first = ~weak & (F.row_number().over(order) == 1)
    reach = F.max(F.when(F.col("strong"), F.col("stop"))).over(Window.partitionBy("doc").orderBy("start", weak).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    able = matches.withColumn("strong", strong_first).withColumn("reach", reach).where(F.col("strong") | weak & F.col("passes") & (F.col("reach").isNull() | (F.col("reach") < F.col("stop"))))
    return able.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "reach", "strong", "passes")


def _filled(template: str, name: str) -> Column:
    groups = PATTERNS[name][1].split()
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    get = lambda g: F.lower(F.regexp_extract("raw", _regex(name), groups.index(g) + 1)) if g == "target_type" else X.strip(F.regexp_extract("raw", _regex(name), groups.index(g) + 1))
    return F.concat(*(get(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts)) if parts else F.lit("")


def _by_pass(value) -> Column:
    out = F.lit(None).cast("string")
    for k, name in enumerate(NAMES):
        out = F.when(F.col("pass") == k, value(name)).otherwise(out)
    return F.nullif(out, F.lit(""))


def extract_references(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each reference in each text, in the order of passes and places; a null text has none, keys must be distinct.

    Everything moves by key: offsets, bounds and containment are windows over a document's matches, and its text is joined
    to them once. It is linear in the text and its matches. Texts are shuffled once, by key, to tasks of a fixed size.
    """
    texts = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = dealt(texts, "doc", F.octet_length("text") + TEXT_BYTES, TASK_BYTES)
    seen = _in_context(texts, _bounded(texts, match_offsets(texts)))
    relation = F.coalesce(_by_pass(lambda n: F.lit(SAYS[n][0] or "")), X.classify_relationship(F.col("sentence")))
    relates = ~F.col("relationship_type").isin("REFERS_TO", "UNKNOWN")
    gated = F.col("pass").isin([NAMES.index(n) for n in GATED])
    rated = seen.withColumns({"relationship_type": relation, "key": X.act_title_form(X.strip(F.col("raw")))}).withColumn("passes", ~gated | relates)
    number, year = (_by_pass(lambda n, g=g: F.regexp_extract("raw", _regex(n), PATTERNS[n][1].split().index(g) + 1) if g in PATTERNS[n][1].split() else F.lit("")) for g in ("number", "year"))
    said = first_wordings(rated).withColumns({
        "title": _by_pass(lambda n: _filled(SAYS[n][1], n)), "section": _by_pass(lambda n: _filled(SAYS[n][2], n)), "path": _by_pass(lambda n: _filled(SAYS[n][3], n)), "number": number, "year": year,
    })
    name = F.regexp_replace(F.regexp_replace(X.squeeze(F.col("title")), r"^[ ,.;:]+|[ ,.;:]+$", ""), r"^[Tt]he ", "")
    name = F.nullif(F.regexp_replace(name, r"(?i)^section\s+\d+[A-Z]?\s+of\s+(?:the\s+)?", ""), F.lit(""))
    has = lambda *c: F.coalesce(*c).isNotNull()
    score = M.extraction_confidence(F.col("relationship_type"), F.col("number").isNotNull() & F.col("year").isNotNull(), has("title"), has("section", "path"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("pass", "start")) - 1
    return said.withColumn("confidence_score", score).select(
        F.col("doc").alias(key), place.alias("position"), X.strip(F.col("raw")).alias("raw_reference_text"), "context_snippet", "relationship_type", F.when(has("title"), name).alias("target_act_title_raw"),
        F.col("number").alias("target_act_number"), F.col("year").cast("int").alias("target_act_year"), X.section_number(F.col("section")).alias("target_section_number"), F.col("path").alias("target_section_path"),
        "confidence_score", F.lit("REGEX").alias("extraction_method"), F.when(F.col("confidence_score") >= 0.7, "PENDING").otherwise("NEEDS_REVIEW").alias("verification_status"),
    )
