"""English stems as column expressions, from tables of rules that SQL can be made of as well.

The rules are those of the public Porter2 (Snowball English) stemmer. A word is lower case
ASCII; a consonant y is written Y while the rules run. R1 is what follows the first non-vowel
after a vowel, R2 the same within R1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the stemmer, and common English stop words.
V, NOT_V = "[aeiouy]", "[^aeiouy]"
LI = "[cdeghkmnrt]"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_STARTS = "gener|commun|arsen"
#: Steps 2 to 4: ending, what takes its place, the region that must hold it (and what must stand before it), longest ending first.
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og", "l"), ("li", "", LI),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", "", "", 2), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = tuple((e, "", *more) for e, *more in (("ement",), ("ance",), ("ence",), ("able",), ("ible",), ("ment",), ("ant",), ("ent",), ("ism",), ("ate",), ("iti",), ("ous",), ("ive",), ("ize",), ("ion", "[st]"), ("al",), ("er",), ("ic",)))
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


class Text:
    """What the rules need of a language: here of columns; ``SqlText`` says the same in SQL."""

    def lit(self, value):
        return F.lit(value)

    def when(self, cases, otherwise):
        out = F.when(*cases[0])
        for c in cases[1:]:
            out = out.when(*c)
        return out.otherwise(otherwise)

    def matches(self, text, pattern):
        return text.rlike(pattern)

    def ends(self, text, *endings):
        out = F.endswith(text, F.lit(endings[0]))
        for e in endings[1:]:
            out = out | F.endswith(text, F.lit(e))
        return out

    def cut(self, text, n, by=""):
        """``text`` with ``by`` in place of its last ``n`` characters."""
        kept = F.substr(text, F.lit(1), F.length(text) - n)
        return F.concat(kept, F.lit(by)) if by else kept

    def replace(self, text, pattern, by):
        return F.regexp_replace(text, pattern, by.replace("\\", "$"))

    def length(self, text):
        return F.length(text)

    def prefix(self, text, pattern):
        """The length of a match of ``pattern`` at the start; 0 without one."""
        return F.length(F.regexp_extract(text, "^(?:" + pattern + ")", 0))

    def both(self, a, b):
        return a & b

    def either(self, a, b):
        return a | b

    def at_least(self, a, b):
        return a >= b

    def add(self, a, b):
        return a + b

    def among(self, text, words):
        return text.isin(*words)

    def with_e(self, text):
        return F.concat(text, F.lit("e"))


class SqlText(Text):
    def lit(self, value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    def when(self, cases, otherwise):
        return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END)"

    def matches(self, text, pattern):
        return f"regexp_matches({text}, '{pattern}')"

    def ends(self, text, *endings):
        return "(" + " OR ".join(f"ends_with({text}, '{e}')" for e in endings) + ")"

    def cut(self, text, n, by=""):
        return f"(substr({text}, 1, length({text}) - {n}) || '{by}')"

    def replace(self, text, pattern, by):
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def length(self, text):
        return f"length({text})"

    def prefix(self, text, pattern):
        return f"length(regexp_extract({text}, '^(?:{pattern})'))"

    def both(self, a, b):
        return f"({a} AND {b})"

    def either(self, a, b):
        return f"({a} OR {b})"

    def at_least(self, a, b):
        return f"({a} >= {b})"

    def add(self, a, b):
        return f"({a} + {b})"

    def with_e(self, text):
        return f"({text} || 'e')"

    def among(self, text, words):
        return f"({text} IN ({', '.join(map(self.lit, words))}))"


#: The start of a word up to R1, and from there up to R2.
TO_REGION = f"{NOT_V}*{V}+{NOT_V}"
SHORT_END = f"({NOT_V}[aeiouy][^aeiouywxY]|^[aeiouy]{NOT_V})$"


def steps(t: Text):
    """(name, expression of the columns w, r1, r2) in order; r1 and r2 are how many characters lie before the regions."""
    w, r1, r2 = ("w", "r1", "r2") if isinstance(t, SqlText) else (F.col("w"), F.col("r1"), F.col("r2"))

    def within(ending: str, region) -> object:
        return t.at_least(t.length(w), t.add(region, t.lit(len(ending))))

    def endings(rules) -> object:
        cases = []
        for ending, by, *more in rules:
            before, region = (more[0] if more else ""), (r2 if rules is STEP_4 or more[1:] == [2] else r1)
            ok = within(ending, region)
            cases.append((t.ends(w, ending), t.when([(t.both(ok, t.matches(w, f"{before}{ending}$")) if before else ok, t.cut(w, len(ending), by))], w)))
        return t.when(cases, w)

    yield "w", t.replace(t.replace(w, "^y", "Y"), f"({V})y", "\\1Y")
    start = t.prefix(w, R1_STARTS)
    yield "r1", t.when([(t.at_least(start, t.lit(1)), start), (t.matches(w, f"^{TO_REGION}"), t.prefix(w, TO_REGION))], t.length(w))
    rest = f"substr({w}, r1 + 1)" if isinstance(t, SqlText) else F.substr(w, r1 + 1)
    yield "r2", t.when([(t.matches(rest, f"^{TO_REGION}"), t.add(r1, t.prefix(rest, TO_REGION)))], t.length(w))
    # 1a: plurals
    yield "w", t.when([
        (t.ends(w, "sses"), t.cut(w, 2)), (t.ends(w, "ied", "ies"), t.when([(t.at_least(t.length(w), t.lit(5)), t.cut(w, 2))], t.cut(w, 1))), (t.ends(w, "us", "ss"), w),
        (t.both(t.ends(w, "s"), t.matches(w, f"{V}.*.s$")), t.cut(w, 1)),
    ], w)
    # 1b: past and progressive; what is left of a cut word gets its e back, or loses a doubled letter
    bare = t.when([(t.ends(w, e), t.cut(w, len(e))) for e in ("ingly", "edly", "ing", "ed")], w)
    yield "bare", bare
    bare = "bare" if isinstance(t, SqlText) else F.col("bare")
    lost = t.both(t.at_least(t.length(w), t.add(t.length(bare), t.lit(1))), t.matches(bare, V))
    short = t.both(t.at_least(r1, t.length(bare)), t.matches(bare, SHORT_END))
    mended = t.when([(t.ends(bare, "at", "bl", "iz"), t.with_e(bare)), (t.ends(bare, *DOUBLES), t.cut(bare, 1)), (short, t.with_e(bare))], bare)
    eed = t.when([(t.ends(w, e), t.when([(within(e, r1), t.cut(w, len(e), "ee"))], w)) for e in ("eedly", "eed")], w)
    done = t.among(w, AFTER_1A)
    yield "done", done
    yield "w", t.when([(_done(t), w), (t.ends(w, "eedly", "eed"), eed), (lost, mended)], w)
    yield "w", t.when([(_done(t), w), (t.both(t.ends(w, "y", "Y"), t.matches(w, f".{NOT_V}[yY]$")), t.cut(w, 1, "i"))], w)
    for rules in (STEP_2, STEP_3, STEP_4):
        yield "w", t.when([(_done(t), w)], endings(rules))
    # 5: a last e or l
    without_e = t.cut(w, 1)
    drop_e = t.either(within("e", r2), t.both(within("e", r1), _not(t, t.matches(without_e, SHORT_END))))
    yield "w", t.when([(_done(t), w), (t.ends(w, "e"), t.when([(drop_e, without_e)], w)), (t.both(t.ends(w, "ll"), within("l", r2)), t.cut(w, 1))], w)
    yield "w", t.replace(w, "Y", "y")


def _done(t: Text):
    return "done" if isinstance(t, SqlText) else F.col("done")


def _not(t: Text, c):
    return f"(NOT {c})" if isinstance(t, SqlText) else ~c


def with_stems(df, token: str = "token"):
    """Add ``lexeme``, the stem of each token (lower case a-z; with digits or shorter than 3 letters as it is)."""
    kept = df.columns
    out = df.withColumn("w", F.col(token))
    for name, expression in steps(Text()):
        out = out.withColumn(name, expression)
    plain = (F.length(token) < 3) | ~F.col(token).rlike("^[a-z]+$")
    table = F.create_map(*(F.lit(x) for kv in EXCEPTIONS.items() for x in kv))
    lexeme = F.when(plain, F.col(token)).otherwise(F.coalesce(F.try_element_at(table, F.col(token)), F.col("w")))
    return out.withColumn("lexeme", lexeme).select(*kept, "lexeme")


def stems_sql(source: str, token: str = "token") -> str:
    """A DuckDB query that adds ``lexeme`` to the rows of ``source`` by the same rules."""
    query = f"SELECT *, {token} AS w, '' AS bare, 0 AS r1, 0 AS r2, false AS done FROM {source}"
    for name, expression in steps(SqlText()):
        query = f"SELECT * REPLACE ({expression} AS {name}) FROM ({query})"
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXCEPTIONS.items())
    return f"SELECT * EXCLUDE (w, bare, r1, r2, done), CASE WHEN length({token}) < 3 OR NOT regexp_matches({token}, '^[a-z]+$') THEN {token} ELSE CASE {token} {named} ELSE w END END AS lexeme FROM ({query})"
