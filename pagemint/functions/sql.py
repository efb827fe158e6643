"""Functions by name for SQL: register(spark), then SELECT page_fold(page_text(html)) ... and the table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.functions import edits, fold, markdown, mathtext, tables, views
from pagemint.functions.numbers import read
from pagemint.operators.summary import id_digest, one_decimal
from pagemint.session import importable


@F.pandas_udf(T.StringType())
def number_core(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: n.core if (n := read(t)) else None, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def search_distance(needles: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edits.search_distance(a, b) for a, b in zip(needles, texts)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits.likeness(x, y) for x, y in zip(a, b)], dtype="float64")


FUNCTIONS = {
    "page_text": views.visible_udf,
    "page_seen": views.seen_udf,
    "page_fold": fold.fold_udf,
    "markdown_html": markdown.to_html_udf,
    "number_core": number_core,
    "search_distance": search_distance,
    "likeness": likeness,
    "id_digest": id_digest,
    "one_decimal": one_decimal,
}


def register(spark: SparkSession) -> SparkSession:
    importable(spark)
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    tables.table_cells(spark)

    @F.udtf(returnType="start int, stop int, body string, is_read boolean, display boolean")
    class MathSpans:
        def eval(self, text: str):
            for s in mathtext.spans(text or ""):
                yield s.start, s.end, s.body, s.read, s.display

    spark.udtf.register("math_spans", MathSpans)
    return spark
