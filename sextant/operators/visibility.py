"""Who sees what, and the metadata filters: predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def acts(role: str, status: Column) -> Column:
    return F.lit(True) if role == "ADMIN" else status.isin("PROCESSED", "VERIFIED")


def sections(role: str, status: Column) -> Column:
    return status == "VERIFIED" if role == "GENERAL_USER" else F.lit(True)


def mapped(target_act: Column, target_section: Column) -> Column:
    return F.coalesce(target_act, target_section).isNotNull()


def references(role: str, status: Column, is_mapped: Column) -> Column:
    return (status == "VERIFIED") & is_mapped if role == "GENERAL_USER" else F.lit(True)


def listed_references(role: str, status: Column, include_pending: bool = False) -> Column:
    """A lawyer's listing shows what is verified, unless pending ones are asked for."""
    return status == "VERIFIED" if role == "LAWYER" and not include_pending else F.lit(True)


def verification(wanted: str | None, status: Column) -> Column:
    if not wanted:
        return F.lit(True)
    return status.isin("VERIFIED", "PENDING", "NEEDS_REVIEW") if wanted == "verified_pending" else status == wanted


def mapped_status(wanted: str | None, is_mapped: Column) -> Column:
    return {"mapped": is_mapped, "unresolved": ~is_mapped}.get(wanted or "", F.lit(True))


def metadata(year: int | None = None, act_number: str | None = None, category: str | None = None, status: str | None = None) -> Column:
    """Filters on act columns; falsy values ask nothing. ``category`` is a LIKE fragment, wildcards included."""
    out = F.lit(True)
    if year:
        out = out & (F.col("year") == year)
    if act_number:
        out = out & (F.col("act_number") == act_number)
    if category:
        out = out & F.col("category").ilike(f"%{category}%")
    if status:
        out = out & (F.col("processing_status") == status)
    return out


def scope(act_id: str | None, section_id: str | None, direction: str = "all") -> Column:
    """References from or to an act or section; without either, all."""
    if section_id:
        source, target = F.col("source_section_id") == section_id, F.col("target_section_id") == section_id
    elif act_id:
        source, target = F.col("source_act_id") == act_id, F.col("target_act_id") == act_id
    else:
        return F.lit(True)
    target = F.coalesce(target, F.lit(False))
    return {"outgoing": source, "incoming": target}.get(direction, source | target)


def ready_embedding(provider: str, model: str, dimension: int) -> Column:
    return (
        F.col("embedding").isNotNull() & (F.col("embedding_status") == "READY") & (F.col("embedding_provider") == provider)
        & (F.col("embedding_model") == model) & (F.col("embedding_dimension") == dimension)
    )


def contains_literal(column: Column, text: str) -> Column:
    """Case-insensitive containment in which % and _ mean themselves."""
    return F.lower(column).contains(text.lower())


def all_terms(column: Column, query: str) -> Column:
    """Full-text match without stemming: every word of the query is a word of the text."""
    words = F.array_distinct(F.split(F.lower(column), r"[^a-z0-9]+"))
    terms = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    return F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words, t)) if terms else F.lit(False)
