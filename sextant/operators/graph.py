"""The citation graph: rows, edges, neighbours, roll-ups and the dossier of an act."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.schemas import RELATIONSHIPS, VERIFICATION


def edges(references: DataFrame, source: str = "source", target: str = "target", label: str = "relationship") -> DataFrame:
    """Weighted edges (source, target, label): count, and whether any citation is unverified. Self-loops and unmapped ones go."""
    rows = references.where(F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return rows.groupBy(F.col(source).alias("source"), F.col(target).alias("target"), F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("verification_status") != "VERIFIED").alias("pending")
    )


def neighbours(edge: DataFrame) -> DataFrame:
    """(act, neighbours, citations): distinct other ends, and citations in either direction."""
    both = edge.select(F.col("source").alias("act"), F.col("target").alias("other"), "n").unionAll(edge.select(F.col("target").alias("act"), F.col("source").alias("other"), "n"))
    return both.groupBy("act", "other").agg(F.sum("n").alias("n")).groupBy("act").agg(F.count("*").alias("neighbours"), F.sum("n").alias("citations"))


def pair_offsets(edge: DataFrame) -> DataFrame:
    """Where among the edges between the same two acts an edge is drawn: its index less the middle."""
    pair = Window.partitionBy("low", "high")
    at = F.row_number().over(pair.orderBy("source", "target", "label")) - 1
    ends = edge.withColumns({"low": F.least("source", "target"), "high": F.greatest("source", "target")})
    return ends.withColumn("offset", at - (F.count("*").over(pair) - 1) / F.lit(2.0)).drop("low", "high")


def nodes(edge: DataFrame, acts: DataFrame) -> DataFrame:
    ids = edge.select(F.col("source").alias("id")).union(edge.select("target")).distinct()
    return ids.join(acts.select("id", "title"), "id", "left")


def visible_nodes(edge: DataFrame, focus: object, limit: int = 8) -> DataFrame:
    """The focus and acts with an edge, the focus first, then by id."""
    ids = edge.select(F.col("source").alias("id")).union(edge.select("target")).union(edge.sparkSession.range(1).select(F.lit(focus).alias("id"))).distinct()
    return ids.orderBy((F.col("id") != focus), "id").limit(limit)


def linked_acts(edge: DataFrame, focus: object) -> DataFrame:
    """(counterpart, total, pending, by_type) of an act's edges in either direction, most citations first."""
    other = F.when(F.col("source") == focus, F.col("target")).otherwise(F.col("source"))
    near = edge.where((F.col("source") == focus) | (F.col("target") == focus)).withColumn("counterpart", other)
    kinds = near.groupBy("counterpart", "label").agg(F.sum("n").alias("n"), F.bool_or("pending").alias("pending"))
    listed = F.array_sort(F.collect_list(F.struct("label", "n")))
    return kinds.groupBy("counterpart").agg(F.sum("n").alias("total"), F.bool_or("pending").alias("pending"), listed.alias("by_type"))


def selected(edge: DataFrame, node: object | None = None, chosen: tuple | None = None) -> DataFrame:
    """Edges of a chosen edge's ends and label; else those of a node; else all."""
    if chosen:
        return edge.where((F.col("source") == chosen[0]) & (F.col("target") == chosen[1]) & (F.col("label") == chosen[2]))
    return edge if node is None else edge.where((F.col("source") == node) | (F.col("target") == node))


def summary(references: DataFrame, focus: object) -> DataFrame:
    """One row: totals by direction and mapping, and counts by type and status."""
    source, target = F.col("source") == focus, F.coalesce(F.col("target") == focus, F.lit(False))
    own = references.where(source | target)
    counted = lambda column, domain: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, domain)), F.array(*(F.count_if(F.col(column) == v) for v in domain))), lambda _, n: n > 0)
    return own.agg(
        F.count("*").alias("total"), F.count_if(F.col("source") == focus).alias("outgoing"), F.count_if(F.col("source") != focus).alias("incoming"),
        F.count_if(F.col("target").isNotNull()).alias("mapped"), F.count_if(F.col("target").isNull()).alias("unresolved"),
        counted("relationship", RELATIONSHIPS).alias("by_type"), counted("verification_status", VERIFICATION).alias("by_status"),
    )


def relationship_rows(references: DataFrame, acts: DataFrame, sections: DataFrame, focus: Column) -> DataFrame:
    """References with both ends' labels; an unmapped target shows what was cited. Four left joins, to-one."""
    a = acts.select("id", "title")
    s = sections.select("id", "section_number", "heading")
    out = references
    for name, table, key in (("source_act", a, "source_act_id"), ("target_act", a, "target_act_id"), ("source_section", s, "source_section_id"), ("target_section", s, "target_section_id")):
        side = table.select(*(F.col(c).alias(f"_{name}_{c}") for c in table.columns))
        out = out.join(side, F.col(key) == F.col(f"_{name}_id"), "left")
    number = F.coalesce("_target_section_section_number", "target_section_number", "target_section_path")
    return out.select(
        *references.columns, F.col("_source_act_title").alias("source_act_title"), F.col("_target_act_title").alias("target_act_title"), F.col("_source_section_section_number").alias("source_section_label"),
        number.alias("target_section_label"), F.when(F.col("source_act_id") == focus, "outgoing").otherwise("incoming").alias("direction"), F.coalesce("target_act_id", "target_section_id").isNotNull().alias("mapped"),
    )


def family_of_type(kind: Column) -> Column:
    return F.when(kind.isin("AMENDS", "REPEALS", "SUBSTITUTES"), "amends").when(kind.isin("INSERTS", "ADDS"), "inserts").otherwise("refers")


def is_internal_citation(number: Column, year: Column, title: Column, raw: Column) -> Column:
    """An unmapped citation that names no act: a part of its own act, "thereof" or "this Act"."""
    title, raw = F.coalesce(title, F.lit("")), F.coalesce(raw, F.lit(""))
    named = number.isNotNull() | year.isNotNull() | X.cited_name(title).isNotNull() | X.cited_name(raw).isNotNull() | title.rlike(r"(?i)Chapter\s+\d+") | raw.rlike(r"(?i)Chapter\s+\d+")
    return ~named & raw.rlike(r"(?i)\b(section|subsection|paragraph|schedule|item|proviso|part)\b|principal enactment|\bthereof\b|\bthis Act\b")


def unresolved_label(title: Column, raw: Column, number: Column, year: Column) -> Column:
    cited = F.concat(F.lit("Act No. "), number, F.lit(" of "), year.cast("string"))
    chapter = F.concat(F.lit("Chapter "), X.found(F.concat_ws(" ", title, raw), r"(?i)Chapter\s+(\d+[A-Z]?)"))
    return F.coalesce(X.cited_name(title), X.cited_name(raw), chapter, cited, F.lit("Unmatched target"))


def dossier(rows: DataFrame) -> DataFrame:
    """Groups of relationship rows by family and counterpart: count, pending, sorted types.

    ``rows`` as from ``relationship_rows``; ``focus`` is each row's own focus act in a column of that name.
    """
    internal = F.coalesce((F.col("target_act_id") == F.col("focus")) | (F.col("target_act_id") == F.col("source_act_id")), F.lit(False))
    bare = F.col("target_act_id").isNull() & is_internal_citation(F.col("target_act_number"), F.col("target_act_year"), F.col("target_act_title_raw"), F.col("raw_reference_text"))
    family = F.when(F.col("direction") == "incoming", "incoming").when(internal | bare, "internal").when(F.col("target_act_id").isNull(), "unresolved").otherwise(family_of_type(F.col("relationship_type")))
    label = unresolved_label(F.col("target_act_title_raw"), F.col("raw_reference_text"), F.col("target_act_number"), F.col("target_act_year"))
    counterpart = F.when(F.col("family") == "incoming", F.col("source_act_id")).when(F.col("family") == "internal", F.coalesce("target_act_id", "source_act_id")).when(F.col("family") != "unresolved", F.col("target_act_id"))
    named = rows.withColumn("family", family).withColumns({"counterpart": counterpart, "label": F.when(F.col("family") == "unresolved", label)})
    return named.groupBy("focus", "family", "counterpart", "label").agg(
        F.count("*").alias("n"), F.bool_or(F.col("verification_status") != "VERIFIED").alias("pending"), F.array_join(F.array_sort(F.collect_set("relationship_type")), ",").alias("types")
    )


def busiest_group(groups: DataFrame) -> DataFrame:
    """For each counterpart the family with most citations."""
    best = F.max(F.struct("n", "family"))
    return groups.where("counterpart IS NOT NULL").groupBy("counterpart").agg(best["family"].alias("family"), best["n"].alias("n"))


def dossier_key(focus: object) -> Column:
    incoming = (F.col("target") == focus) & (F.col("source") != focus)
    return F.concat_ws("|", F.when(incoming, "incoming").otherwise(family_of_type(F.col("label"))), F.when(incoming, F.col("source")).otherwise(F.col("target")).cast("string"))
