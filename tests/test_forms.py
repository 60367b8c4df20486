"""Forms of texts beyond ASCII."""

import pandas as pd
from pyspark.sql import functions as F

from sextant.functions import text as X


def test_search_form_composes(spark):
    df = spark.createDataFrame([("ＦＩＳＨ ﬁn ²",), ("Plain, text",), (None,), ("Café",)], "t string")
    assert [r.f for r in df.select(X.search_form(F.col("t")).alias("f")).collect()] == ["fish fin 2", "plain text", "", "caf"]


def test_only_texts_in_which_it_matters_are_composed(spark):
    points = [k for k in (*range(0x80, 0x3400), *range(0xA600, 0xD800), *range(0xF900, 0x11000), *range(0x1D000, 0x1F300))]
    rows = [(t,) for k in points for t in (f"x{chr(k)}", f"é{chr(k)}̣e")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["t"])).cache()
    with_all = X.search_form(X.nfkc(F.col("t")), compose=False)
    assert df.where(X.search_form(F.col("t")) != with_all).count() == 0
    assert spark.createDataFrame([("“Straße” – Москва… ありがとう",)], "t string").where(F.col("t").rlike(X.composable())).isEmpty()
