"""Text functions as column expressions; Java regexes, ASCII classes unless said otherwise.

Every function maps null to null or to what its docstring says, and keeps to one pass of built-in
functions. Only ``nfkc`` and the fuzzy ratio run Python, in Arrow batches.
"""

from __future__ import annotations

import difflib
import unicodedata
from functools import cache
from html import unescape
from string import ascii_letters, digits

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Patterns and word lists that results depend on.
ACT_NUMBER = r"(?i)\bNo\.?\s*(\d+[A-Z]?)\s+of\s+(\d{4})\b"
CHAPTER = r"(?i)\bChapter\s+(\d+[A-Z]?)\b"
SCHEDULE = r"(?i)\b((?:(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth)\s+)?Schedule(?:\s+[IVXLCDM]+)?)\b"
PART = r"(?i)\bPart\s+([IVXLCDM]+[A-Z]?)\b"
CITED_NAME = r"\b([A-Z][A-Za-z0-9'’]*(?:\s+(?:and|of|the|for|&|[A-Z][A-Za-z0-9'’-]*)){0,5}\s+(?:Act|Ordinance))\b"
WEAK_TITLES = ("fund act", "trust act", "the code", "code")
PHRASES = {
    "AMENDS": ("amended by", "is amended", "is hereby amended", "shall be amended", "amendment of section", "principal enactment is hereby amended"),
    "REPEALS": ("is hereby repealed", "shall be repealed", "repeal of", "is repealed"),
    "INSERTS": ("following new section is inserted", "inserted immediately after section", "there shall be inserted", "is inserted", "is hereby inserted"),
    "SUBSTITUTES": ("by the substitution for", "substitution therefor", "is substituted by", "following section is substituted", "substitute therefor", "substituted therefor"),
    "ADDS": ("by the addition immediately after", "addition immediately after", "following new paragraph", "following new item", "there shall be added"),
    "CROSS_REFERENCE": ("referred to in section", "subject to section", "in accordance with section", "under section", "for the purposes of section", "subject to the provisions of"),
}
RELATIONSHIP_WORDS = {
    "refer": "REFERS_TO", "refers": "REFERS_TO", "refers_to": "REFERS_TO", "cross_reference": "CROSS_REFERENCE", "cross_references": "CROSS_REFERENCE", "cross_reference_to": "CROSS_REFERENCE",
    "amend": "AMENDS", "amends": "AMENDS", "amended": "AMENDS", "repeal": "REPEALS", "repeals": "REPEALS", "insert": "INSERTS", "inserts": "INSERTS",
    "substitute": "SUBSTITUTES", "substitutes": "SUBSTITUTES", "add": "ADDS", "adds": "ADDS", "addition": "ADDS", "commences": "COMMENCES", "defines": "DEFINES", "unknown": "UNKNOWN",
}


#: A text of Latin letters and signs that NFKC leaves alone; none of them combines with another.
COMPOSED = "^[" + "".join(f"\\x{{{c:x}}}" for c in range(0x180) if unicodedata.normalize("NFKC", chr(c)) == chr(c)) + "]*$"


@cache
def composable() -> str:
    """A class of the characters for whose sake a text's search form needs NFKC; without one of these the form is the same.

    They are those that NFKC turns into ASCII letters or digits, and the marks that it joins with an ASCII letter before them.
    """
    alnum = frozenset(ascii_letters + digits)
    joins = {m for m in map(chr, range(0x80, 0x3100)) if unicodedata.combining(m) and any(len(unicodedata.normalize("NFKC", a + m)) == 1 for a in alnum)}

    def counts(c: str) -> bool:
        apart = unicodedata.normalize("NFKD", c)
        if unicodedata.combining(apart[0]):
            return not joins.isdisjoint(apart)
        return apart != c and not alnum.isdisjoint(apart) and unicodedata.normalize("NFKC", c) != c

    found = [k for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000 and counts(chr(k))]
    starts = [k for k, before in zip(found, [-1, *found], strict=False) if k != before + 1]
    stops = [k for k, after in zip(found, [*found[1:], -1], strict=True) if k + 1 != after]
    # ASCII and the letters of Latin-1, of which none is in the list, are asked for first, as it is long
    return "[[^\\x00-\\x7F\\xC0-\\xFF]&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, stops, strict=True)) + "]]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (0 to 1); null if either side is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape(t))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def search_form(text: Column, compose: bool = True) -> Column:
    """Lower case; all but a-z and 0-9 become single spaces; null becomes empty. ``compose``: NFKC first (only texts in which it matters go to Python, see ``composable``)."""
    t = F.coalesce(nfkc(F.when(text.rlike(composable()), text)), text) if compose else text
    return F.coalesce(F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " ")), F.lit(""))


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    """Without the Unicode white space at its ends."""
    text = F.regexp_replace(text, r"(?U)^\s+", "") if left else text
    return F.regexp_replace(text, r"(?U)\s+\z", "") if right else text


def squeeze(text: Column) -> Column:
    """Unicode white space collapsed and trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def clean(text: Column, compose: bool = True) -> Column:
    """Page text: hyphenated line ends joined, line feeds and blanks normalised, page-number lines blanked, trimmed."""
    t = nfkc(text) if compose else text
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?imUd)^\s*(printed on|page)\s+\d+.*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def act_title_form(title: Column, compose: bool = True) -> Column:
    """A title without citation number, chapter and trailing punctuation, in search form."""
    t = F.regexp_replace(squeeze(title), r"(?i),?\s+No\.?\s*\d+[A-Z]?\s+of\s+\d{4}\b", "")
    t = F.regexp_replace(t, r"(?i)\(Chapter\s+\d+[A-Z]?\)", "")
    return search_form(F.regexp_replace(t, r"[,:;]+$", ""), compose)


def act_number(value: Column) -> Column:
    return F.upper(found(value, r"(?i)(\d+[A-Z]?)"))


def year(value: Column) -> Column:
    return found(value, r"(\d{4})").cast("int")


def citation(text: Column) -> Column:
    """struct(number, year, title): the title is what stands before the number, or all of a text without one."""
    t = squeeze(text)
    at = F.regexp_instr(t, F.lit(r"(?i)\b(?:Act,?\s+)?No\.?\s*\d+[A-Z]?\s+of\s+\d{4}\b"))
    before = F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t)
    title = F.nullif(F.when(at > 0, F.regexp_replace(F.regexp_replace(before, r"^[ ,.;:]+", ""), r"[ ,.;:]+$", "")).otherwise(t), F.lit(""))
    return F.struct(found(t, ACT_NUMBER, 1).alias("number"), found(t, ACT_NUMBER, 2).cast("int").alias("year"), title.alias("title"))


def cited_name(text: Column) -> Column:
    """The longest act or ordinance name in a text (the first of equals), or null."""
    padded = F.regexp_replace(text, r"([a-z])(Act|Ordinance)\b", "$1 $2")
    names = F.transform(F.regexp_extract_all(padded, F.lit(CITED_NAME), F.lit(1)), lambda n: squeeze(F.regexp_replace(n, r"^(?i:The|And|Of)\s+", "")))
    names = F.filter(names, lambda n: (F.length(n) >= 5) & ~F.lower(n).isin(*WEAK_TITLES))
    ranked = F.transform(names, lambda n, k: F.struct(F.length(n).alias("n"), (-k).alias("k"), n.alias("name")))
    return F.array_max(ranked)["name"]


def chapter(text: Column) -> Column:
    return F.concat(F.lit("Chapter "), F.upper(found(text, CHAPTER)))


def section_number(text: Column) -> Column:
    t = F.regexp_replace(squeeze(text), r"(?i)^(?:section|sections|s\.|sec\.|subsection|paragraph|item)\s+", "")
    t = F.nullif(F.regexp_replace(t, r"(?U)\s+", ""), F.lit(""))
    return F.when(t.rlike(r"(?i)^\d+[A-Z]*$"), F.upper(t)).otherwise(F.lower(t))


def schedule(text: Column) -> Column:
    """Words capitalised unless all upper case."""
    words = F.split(squeeze(found(text, SCHEDULE)), " ")
    one = F.transform(words, lambda w: F.when(F.upper(w) == w, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100)))))
    return F.when(found(text, SCHEDULE).isNotNull(), F.array_join(one, " "))


def target_path(text: Column) -> Column:
    """Schedule, chapter or part if there is one; else the path with its keywords in lower case."""
    t = F.regexp_replace(F.regexp_replace(squeeze(text), r"^[ ,.;:]+", ""), r"[ ,.;:]+$", "")
    rest = t
    for word, what in (("subsection", r"\(([^)]+)\)"), ("paragraph", r"\(([^)]+)\)"), ("item", r"(\d+[A-Z]?)"), ("section", r"(\d+[A-Z]?)")):
        rest = F.regexp_replace(rest, rf"(?i)\b{word}\s+{what}", rf"{word} {'($1)' if '(' in what[1:3] else '$1'}")
    part = F.concat(F.lit("Part "), F.upper(found(t, PART)))
    return F.when(F.nullif(text, F.lit("")).isNotNull(), F.coalesce(schedule(t), chapter(t), part, rest))


def relationship_word(value: Column) -> Column:
    """The relationship type that a word names, or null."""
    key = F.translate(F.lower(F.trim(value)), "- ", "__")
    table = F.create_map(*(F.lit(x) for kv in RELATIONSHIP_WORDS.items() for x in kv))
    return F.try_element_at(table, F.coalesce(key, F.lit("")))


def classify_relationship(context: Column) -> Column:
    """The first family one of whose phrases occurs, else REFERS_TO near a section or act, else UNKNOWN."""
    low, out = F.lower(context), None
    for kind, phrases in PHRASES.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(low.contains("section") | low.contains("act"), "REFERS_TO").otherwise("UNKNOWN")


def snippet(text: Column, query: str, width: int = 220) -> Column:
    """``width`` characters from 73 before the query's first occurrence, or from the start."""
    t = squeeze(text)
    at = F.instr(F.lower(t), query.lower())
    return F.substr(t, F.greatest(F.lit(1), at - 73), F.lit(width))


def csv_safe(value: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def evaluation_key(value: Column) -> Column:
    return F.lower(squeeze(value))


def source_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def embedding_text(*parts: Column) -> Column:
    """The non-blank parts, trimmed, one to a line."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def first_tokens(text: Column, n: int = 256) -> Column:
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def type_label(kind: Column) -> Column:
    """CROSS_REFERENCE -> Cross reference."""
    low = F.translate(F.lower(kind), "_", " ")
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 200))


def html_to_text(html: Column) -> Column:
    """Tags dropped, white space squeezed; entities stay (see ``entities``)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def markdown_to_text(text: Column) -> Column:
    """Markdown of a converted page as plain lines: links, tags, headings and emphasis go, table bars become spaces."""
    t = entities(text)
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"(?m)^\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-*:?\s*$", "")
    t = F.regexp_replace(t, r"(?m)^\s*\|(.*)\|\s*$", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"(\*\*|__)(.*?)\1", "$2")
    t = F.regexp_replace(t, r"(?<![\w*])\*(?!\s)([^*\n]+)\*", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]*\|[ \t]*", " "), r"[ \t]+", " ")


def loose_date(text: Column) -> Column:
    """"12th January 2020" or "12 Jan 2020" as a date, else null."""
    t = F.regexp_replace(squeeze(text), r"(?i)^(\d{1,2})(st|nd|rd|th)\b", "$1")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMMM yyyy")), F.try_to_timestamp(t, F.lit("d MMM yyyy"))).cast("date")


# Titles that stand for none.
PLACEHOLDERS = (r"(?i)documents\.gov\.lk", r"(?i)can be downloaded", r"(?i)^this act\b", r"(?i)^untitled$", r"(?i)^pdf document$")


def is_placeholder_title(title: Column) -> Column:
    t = F.coalesce(F.trim(title), F.lit(""))
    out = F.length(t) < 4
    for p in PLACEHOLDERS:
        out = out | t.rlike(p)
    return out


def display_title(title: Column, number: Column, year_: Column, file_name: Column) -> Column:
    """The title, else what is known of number and year, else the file's stem with blanks, else "Untitled Act"."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), r"[_-]+", " "))
    n, y = F.nullif(number.cast("string"), F.lit("")), F.nullif(year_, F.lit(0)).cast("string")
    cited = F.coalesce(F.concat(F.lit("Act No. "), n, F.lit(" of "), y), F.concat(F.lit("Act No. "), n), F.concat(F.lit("Act of "), y))
    return F.coalesce(F.when(~is_placeholder_title(title), F.trim(title)), cited, F.when(F.length(stem) > 3, stem), F.lit("Untitled Act"))
