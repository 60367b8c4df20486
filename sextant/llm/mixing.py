"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the token-weighted divergence sum n (r log r - r) from taking
everything once, subject to each source's token target and r <= ``most``. The dual has one
multiplier l per source, the rates are r = min(most, exp(l)), and its Newton steps need for
every source the tokens at the present rates and their derivative: sums over the documents
that Spark takes anew in each iteration. Rates are then rounded to whole copies: among
documents of one source and one size, as many get the upper copy as keeps the source's running
total nearest its running expectation, from the largest size to the least. What is left at the
end is at most half a document of the last size that could still give way; where the small documents of
a source are all taken, or none is, that is more than half its smallest one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD, drop, settle

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one source and size are ranked in this many slices by a hash, so none grows into one task.
SLICES = 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the whole by weight, capped, the excess reshared.

    Sources in code-point order, null last, take the weights in turn. The capped shares are
    min(most * size, level * weight) at the one level that spends the whole: sources are capped in
    order of most * size / weight as long as the level over the rest exceeds that ratio. The
    windows run over one row for each source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*map(F.lit, weights))
    ranked = sums.withColumn("weight", F.element_at(given, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": most * F.col("source_size").cast("double"), "all_size": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    placed = ranked.withColumns({"rank": F.row_number().over(tight), "level": (F.col("all_size") - before) / rest})
    # the first source that is not capped gives the level for itself and all that follow
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("rank", "level"))).over(Window.partitionBy())
    share = F.when(F.col("rank") >= F.col("first.rank"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap"))
    return placed.withColumn("first", first).select("source", "source_size", share.alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: float = 3.0, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """(source, rate): the tilted rates that meet ``targets``.

    ``cells``: (source, size, n), documents counted by source and size. Each step is an aggregation
    of the cells at the present rates, joined to the multipliers; only the largest relative
    error comes to the driver. A source without tokens, or whose target is its cap, has a closed form.
    """
    start = F.when(F.col("target") >= most * F.col("source_size"), F.log(F.lit(most))).otherwise(F.lit(0.0))
    state = targets.select("source", F.col("target"), start.alias("l"), (F.col("target") >= most * F.col("source_size")).alias("tight"))
    files = max(1, targets.count() // 100_000)
    for _ in range(steps):
        at = cells.alias("c").join(state.alias("s"), F.expr("c.source <=> s.source"))
        tokens = F.sum(F.col("size") * F.col("n") * F.least(F.lit(float(most)), F.exp("l")))
        slope = F.sum(F.when(F.exp("l") <= most, F.col("size") * F.col("n") * F.exp("l")).otherwise(0.0))
        # the derivative at the cap is taken from below, so that a step can leave it
        slope = F.greatest(slope, tokens / most)
        taken = at.groupBy("s.source", "target", "l", "tight").agg(tokens.alias("tokens"), slope.alias("slope"))
        moved = F.col("l") - (F.col("tokens") - F.col("target")) / F.col("slope")
        free = ~F.col("tight") & (F.col("slope") > 0) & (F.col("target") > 0)
        moved = F.least(moved, F.log(F.lit(float(most))))
        error = F.when(free, F.abs(F.col("tokens") - F.col("target")) / F.col("target")).otherwise(0.0)
        # one row for each source: a file or few, not one for each shuffle partition
        last, state = state, settle(taken.coalesce(files).select("source", "target", F.when(free, moved).otherwise(F.col("l")).alias("l"), "tight", error.alias("error")), "multipliers")
        if hasattr(last, "_sextant_path"):
            drop(last)
        if (state.agg(F.max("error")).first()[0] or 0.0) < tolerance:
            break
    return state.select("source", F.least(F.lit(float(most)), F.exp("l")).alias("rate"))


def _quotas(group: pd.DataFrame) -> pd.DataFrame:
    """For one source's cells: how many of each get the upper copy. One row per distinct size."""
    group = group.sort_values("size", ascending=False)
    carry, out = 0.0, []
    for size, n, rate in zip(group["size"], group["n"], group["rate"], strict=True):
        part = rate - int(rate)
        if part > 1 - 1e-9 or part < 1e-9:  # a whole rate, but for rounding
            out.append(0)
            continue
        want = part * size * n + carry
        take = min(max(round(want / size if size else part * n), 0), n)
        carry = want - take * size
        out.append(take)
    return pd.DataFrame({"source": group["source"], "size": group["size"], "rate": group["rate"], "upper": out})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """For every row: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts the words of the whole text (null: none); taken = size * copies, copies <= most.
    The upper copies within a source and size go by a hash of doc_id, so reruns agree; rows that repeat a
    doc_id share the hash and are told apart by nothing else, so some of them may round up and
    others down. Sources may be null. Sources without words take nothing: their rate is that of their
    cap and their target 0. An empty table gives an empty result.
    """
    sizes = settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    cells = settle(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = settle(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "targets")
    rates = balance(cells, targets, most)
    rated = cells.alias("c").join(rates.alias("r"), F.expr("c.source <=> r.source")).select("c.source", "c.size", "c.n", "r.rate")
    quotas = rated.groupBy("source").applyInPandas(_quotas, "source string, size long, rate double, upper long")

    hashed = F.xxhash64(F.lit("copies"), "doc_id")
    ranked = sizes.withColumns({"h": hashed, "slice": F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(SLICES)).cast("int")})
    counts = ranked.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "size", "slice", before.alias("before"))
    offsets = offsets.alias("o").join(quotas.alias("q"), F.expr("o.source <=> q.source AND o.size = q.size"))
    offsets = offsets.select("o.source", "o.size", "slice", "rate", (F.col("upper") - F.col("before")).alias("quota"))
    offsets = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.*", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("h", "doc_id"))
    placed = ranked.withColumn("rank", rank).alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source AND d.size = o.size AND d.slice = o.slice"))
    copies = F.floor(F.col("rate") + 1e-9) + F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, 0).otherwise((F.col("rank") <= F.col("quota")).cast("int"))
    out = placed.select("d.doc_id", "d.source", "d.size", "o.source_size", "o.target", "o.rate", copies.cast("long").alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
