"""Order statistics by refined histograms against sorting."""

import math
import random

import pytest

from sextant.operators import ranks


@pytest.mark.parametrize("bins", [4, 4096])
def test_values_at_every_place(spark, bins, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", bins)
    rng = random.Random(2)
    for values, kind in (
        ([rng.randint(-50, 50) for _ in range(200)], "int"), ([rng.randint(-(1 << 61), 1 << 61) for _ in range(50)] + [7] * 60, "long"), ([3] * 40, "long"), ([-(1 << 63), 0, (1 << 63) - 1], "long"),
        ([rng.gauss(0, 1) for _ in range(99)] + [1e300, -1e300, 1e-300, 0.0], "double"), ([1.7e308, -1.7e308, 5.0], "double"), ([], "long"),
    ):
        df = spark.createDataFrame([(v,) for v in [*values, None, *([math.nan] if kind == "double" else [])]], f"x {kind}").repartition(3)
        places = sorted({1, 2, len(values) // 2, len(values) * 95 // 100, len(values) - 1, len(values)})
        assert ranks.values_at(df, "x", [*places, 0, len(values) + 1]) == {p: sorted(values)[p - 1] for p in places if 1 <= p <= len(values)}


def test_nearest_rank():
    assert [ranks.nearest_rank(0.95, n) for n in (1, 19, 20, 21, 100)] == [1, 19, 19, 20, 95]
