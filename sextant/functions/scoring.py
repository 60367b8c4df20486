"""Vector, ranking and confidence functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOST = 200.0
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for null, empty or zero vectors and unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(1.0)


def similarity_score(distance: Column) -> Column:
    return F.round(F.greatest(1.0 - distance, F.lit(0.0)) * 100.0, 2)


def valid_vector(v: Column, n: int) -> Column:
    return (F.size(v) == n) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def rrf(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + rank), F.lit(0.0))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def extraction_confidence(kind: Column, has_number: Column, has_title: Column, has_section: Column) -> Column:
    says = ~kind.isin("UNKNOWN", "REFERS_TO")
    return (
        F.when(says & has_number, 0.95).when(says & has_title & has_section, 0.85).when(says & (has_title | has_section), 0.70)
        .when(says, 0.50).when(has_title | has_section, 0.30).otherwise(0.20)
    )


def mapping_confidence(match: Column, has_section: Column) -> Column:
    """By kind of match (exact, partial, inferred, null for none), with and without a section or structured target."""
    pairs = {"exact": (0.98, 0.92), "partial": (0.88, 0.82), "inferred": (0.78, 0.68)}
    out = F.when(F.lit(False), 0.0)
    for name, (with_, without) in pairs.items():
        out = out.when(match == name, F.when(has_section, with_).otherwise(without))
    return out.otherwise(F.when(has_section, 0.55).otherwise(0.35))


def stroke_width(n: Column) -> Column:
    return F.least(F.lit(8.0), 1.75 + 1.35 * F.log2(F.greatest(F.lit(1.0), n.cast("double"))))


def metadata_confidence(title: Column, number: Column, dated: Column) -> Column:
    return F.least(F.round(title + F.when(number, 0.08).otherwise(0.0) + F.when(dated, 0.04).otherwise(0.0), 2), F.lit(0.98))
