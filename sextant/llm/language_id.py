"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its byte trigrams comes from language l with the
document's proportion of l, with the trigram probabilities of l. Expectation-maximisation
finds the proportions; languages are added to the set, best first, as long as the likelihood
of the set, less a penalty for each language, rises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigrams are hashed to this many cells.
CELLS = 1 << 16
#: The classifier is fitted on about this many labelled rows of each language, at most.
SAMPLE = 3_000
#: Overlapping trigrams are not independent: a trigram counts as a third of an observation.
OVERLAP = 3.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)  # A-Z lower-cased, other ASCII but letters and apostrophes blank
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha() and b != 39]] = 32


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's trigrams and their counts; runs of blanks count as one."""
    b = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    if len(code) > CELLS // 4:
        counts = np.bincount(code, minlength=CELLS)
        cells = np.flatnonzero(counts)
        return cells, counts[cells].astype(float)
    cells, counts = np.unique(code, return_counts=True)
    return cells.astype(np.int64), counts.astype(float)


@dataclass(frozen=True)
class Model:
    """``table``: log probabilities, a row for each of ``languages``."""

    languages: list[str]
    table: np.ndarray


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``usable`` holds and neither is null.

    Of a language with more than ``sample`` such rows, those are read whose hash of doc_id falls below
    the share that leaves about ``sample``; the choice does not depend on partitioning. What
    reaches the driver is bounded by the number of languages and ``CELLS``.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, CELLS), np.float32))
    share = F.element_at(F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n))))), F.col("lang"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                cells, counts = grams(text)
                sums.setdefault(lang, np.zeros(CELLS))[cells] += counts
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "cell": cells, "n": total[cells]})

    chosen = rows.where(place < share).select("lang", "text")
    total = chosen.mapInPandas(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), CELLS), 0.1)
    table[[languages.index(x) for x in total["lang"]], total["cell"]] += total["n"]
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def proportions(model: Model, cells: np.ndarray, counts: np.ndarray, rounds: int = 12) -> dict[int, float]:
    """The chosen languages and their proportions."""
    logs = model.table[:, cells].astype(np.float64)
    n = counts.sum()
    alone = logs @ counts
    chosen = [int(alone.argmax())]
    best, share = float(alone[chosen[0]]), np.ones(1)
    penalty = OVERLAP * 0.5 * np.log(n + 1.0) + OVERLAP
    likely = np.exp(logs - logs.max(axis=0))
    top = float(logs.max(axis=0) @ counts)
    while len(chosen) < len(model.languages) and top - best > penalty:
        mixed = share @ likely[chosen]
        # the slope of the likelihood towards each other language
        slope = likely @ (counts / mixed) / n
        slope[chosen] = 0
        extra = int(slope.argmax())
        if slope[extra] <= 1.0:
            break
        trial, weight = [*chosen, extra], np.append(share * 0.8, 0.2)
        for _ in range(rounds):
            part = weight[:, None] * likely[trial]
            weight = (part / part.sum(axis=0)) @ counts / n
        value = float(np.log(weight @ likely[trial]) @ counts) + top
        if value - best <= penalty:
            break
        chosen, share, best = trial, weight, value
    return dict(zip(chosen, share.tolist(), strict=True))


def classifier(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to a struct: ``lang_pred`` (a learned language, or ``und``), ``score`` (its proportion).

    A null text, one without any letter, and any text if nothing was learned are ``und`` with score 0.
    """
    shared = spark.sparkContext.broadcast(model)

    def one(text: str | None) -> tuple[str, float]:
        known = shared.value
        if not text or not known.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        cells, counts = grams(text)
        found = proportions(known, cells, counts)
        pick = max(found, key=lambda k: (found[k], -k))
        return known.languages[pick], min(1.0, found[pick])

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return judge


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; columns that have these names are replaced, others pass through."""
    judged = docs.withColumn("_judged", classifier(docs.sparkSession, model)(F.col("text")))
    return judged.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")
