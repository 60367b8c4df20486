"""Chat formatting: records of many layouts become canonical turns, turns become marked text with a loss mask.

A record's layout is known by the hash of its nested field paths (``messages[].role``): of a
frame's schema on the driver, of a column of JSON records for every row. The hash selects a
declarative mapping (``LAYOUTS``) of fields to turns. All of it is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Layout:
    """How a record holds its turns: as rows, as a list of (role, text), or as fields of one exchange.

    ``turns`` names for each role the fields whose texts, joined by an empty line, are its turn;
    a turn of which no field has text is left out if all its fields are optional. ``roles`` renames roles.
    """

    name: str
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items:
            return (f"{self.items[0]}[].{self.items[1]}", f"{self.items[0]}[].{self.items[2]}")
        return self.rows or tuple(dict.fromkeys(f for _, fields in self.turns for f in fields))

    def prints(self) -> Iterator[str]:
        """The fingerprints of records with all of the fields that must be there and any of the others."""
        needed, spare = [p for p in self.paths if p not in self.optional], [p for p in self.paths if p in self.optional]
        for n in range(len(spare) + 1):
            for some in combinations(spare, n):
                yield fingerprint([*needed, *some])


NAMED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: The layouts known at first, the earlier before the later where a record has the fields of several.
LAYOUTS = (
    Layout("turn rows", rows=("turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content"), roles=NAMED),
    Layout("from and value", items=("conversations", "from", "value"), roles=NAMED),
    Layout("prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset(["system"])),
    Layout("prompt and completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset(["system", "input"])),
    Layout("question and answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(kind: DataType, under: str = "") -> list[str]:
    """The nested paths of all fields that hold no further fields."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{under}[]")
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{under}.{f.name}" if under else f.name)]
    return [under]


def _known(layouts: Iterable[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def layout_of(schema: StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema's known paths have; if there is none, the first whose own paths have it. Other fields don't count."""
    known, has = {p: x for x in reversed(layouts) for p in x.prints()}, set(field_paths(schema))
    for paths in (_known(layouts), *(x.paths for x in layouts)):
        if found := known.get(fingerprint(has.intersection(paths))):
            return found
    raise ValueError(f"no layout fits the fields {sorted(has)}")


TURN = "array<struct<role:string,text:string>>"


def _turns(layout: Layout, text_of, items_of) -> Column:
    """The canonical turns of a record: ``text_of(field)`` and ``items_of(field, role, text)`` read its parts."""
    renamed = {a: b for a, b in layout.roles}
    role = lambda c: F.coalesce(F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))[F.lower(c)], c, F.lit("")) if renamed else F.coalesce(c, F.lit(""))
    if layout.items:
        return F.coalesce(F.transform(items_of(*layout.items), lambda x: F.struct(role(x["role"]).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))), F.array().cast(TURN))
    made = []
    for who, fields in layout.turns:
        texts = [F.when(text_of(f) != "", text_of(f)) for f in fields]
        turn = F.struct(F.lit(who).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))
        made.append(F.when(F.coalesce(*texts).isNotNull(), turn) if set(fields) <= layout.optional else turn)
    return F.array_compact(F.array(*made))


def turns_of_frame(df: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of every record of ``df``, whose schema selects the layout; a frame of no known layout raises.

    Missing texts and roles count as empty. Turns of one exchange or list are numbered from 0;
    rows keep their own numbers. Columns that no layout names are not read; ``key`` may bear any name.
    """
    layout = layout_of(StructType([f for f in df.schema.fields if f.name != key]), layouts)
    if layout.rows:
        turn, role, text = layout.rows
        return df.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumnRenamed("key", key)
    has = set(field_paths(df.schema))
    text_of = lambda f: F.col(f).cast("string") if f in has else F.lit(None).cast("string")
    items_of = lambda f, role, text: F.transform(F.col(f), lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))
    return _exploded(df.select(F.col(key).alias("key"), _turns(layout, text_of, items_of).alias("turns")), key)


def _exploded(found: DataFrame, key: str) -> DataFrame:
    return found.select("key", F.posexplode("turns").alias("turn", "one")).select(F.col("key").alias(key), F.col("turn").cast("long").alias("turn"), "one.role", "one.text")


def turns_of_json(df: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """(key, turn, role, text) of records in JSON, each of its own layout; and (key, record) of those that have none.

    A record's paths are those of the known ones that it holds, null or not; a list's are those of any of its
    items, and an empty list has all of its paths. What is no JSON, or null, has no layout.
    """
    layouts = tuple(x for x in layouts if not x.rows)
    parsed = df.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record")).withColumn("v", F.try_parse_json("record"))
    lists = {x.items[0]: sorted({p for y in layouts if y.items and y.items[0] == x.items[0] for p in y.items[1:]}) for x in layouts if x.items}
    as_items = lambda f: F.try_variant_get("v", f"$.{f}", f"array<struct<{','.join(f'`{p}`:variant' for p in lists[f])}>>")

    def has(path: str) -> Column:
        if "[]." not in path:
            return F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
        f, inner = path.split("[].")
        return F.exists(as_items(f), lambda x: x[inner].isNotNull()) | (F.size(as_items(f)) == 0)

    own = parsed.withColumn("paths", F.array_compact(F.array(*(F.when(has(p), F.lit(p)) for p in _known(layouts)))))
    known = {p: x.name for x in reversed(layouts) for p in x.prints()}
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    digest = lambda paths: F.sha2(F.array_join(F.array_sort(paths), "\n").cast("binary"), 256)
    tried = [names[digest(F.col("paths")) if among is None else digest(F.array_intersect("paths", F.array(*map(F.lit, among))))] for among in (None, *(x.paths for x in layouts))]
    chosen = own.withColumn("layout", F.coalesce(*tried))
    turns = F.lit(None).cast(TURN)
    text_of = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    items_of = lambda f, role, text: F.try_variant_get("v", f"$.{f}", f"array<struct<`{role}`:string,`{text}`:string>>")
    for x in layouts:
        read = _turns(x, text_of, lambda f, role, text: F.transform(items_of(f, role, text), lambda y: F.struct(y[role].alias("role"), y[text].alias("text"))))
        turns = F.when(F.col("layout") == x.name, read).otherwise(turns)
    unknown = chosen.where("layout IS NULL").select(F.col("key").alias(key), F.col("record").alias(record))
    return _exploded(chosen.where("layout IS NOT NULL").select("key", turns.alias("turns")), key), unknown


# Marks of public chat templates.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A control string: an opening bracket, then a tail without one, so that no two overlap. Between them a text's may have backslashes.
CONTROL = r"([<\[])(\\*)(/?s>|/?SYS>|\|[A-Za-z0-9_ -]+\|>|/?INST\])"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    """``text`` with one backslash more in each control string, so that none is left; ``unescape`` takes it out again."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_turns(turns: DataFrame, key: str, learned: str = "assistant") -> DataFrame:
    """Per key: formatted, and loss_spans, the UTF-8 byte ranges [start, end) of the texts that role ``learned`` says.

    A turn is START role MIDDLE text END, with control strings in role and text escaped. Turns are ordered by number (null
    last), then role and text; keys may be null. Rows are shuffled once, by key, where a
    window and the grouping share the order; a conversation is one row of output and must fit in a task.
    """
    own = turns.select(F.col(key).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    made = own.select("key", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    long = lambda c: F.octet_length(c).cast("long")
    in_order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    stop = F.sum(long(F.col("head")) + long(F.col("body")) + len(END)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    placed = made.withColumns({"stop": stop, "at": F.row_number().over(in_order)})
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == learned, F.struct((F.col("stop") - long(F.col("body"))).alias("start"), F.col("stop").alias("end"))).alias("span"))
    pieces = placed.groupBy("key").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return pieces.select(F.col("key").alias(key), F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.array_compact(F.col("pieces.span")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    parts = F.split(formatted, F.lit(END.replace("|", r"\|")), -1)
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), MIDDLE, 1)
    text = lambda x: F.substr(x, F.instr(x, MIDDLE) + len(MIDDLE))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.struct(unescape(role(x)).alias("role"), unescape(text(x)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, as an array. Byte ranges are cut from bytes, without a walk from the start."""
    raw = formatted.cast("binary")
    return F.transform(spans, lambda x: unescape(F.substr(raw, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).cast("string")))
