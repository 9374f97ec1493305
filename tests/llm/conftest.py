from __future__ import annotations

import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "A plain text of some words, nothing else.\nSecond line.", "en", "a"),
        (1, "A plain text of some words, nothing else.\nSecond line.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, "a document without an id has a text too", "en", "b"),
        (4, LONG, "en", "a"),
        (5, LONG, "de", None),
        (6, "x", "fr", "c"),
        (7, "日本語 ünïcödé \U0001f600 ▁ end\t\r\n", None, "c"),
        (8, "\n\n \n", "en", "c"),
    ]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), *[T.StructField(n, T.StringType()) for n in
        ("row", "score", "kept", "n_lines", "ids", "tid", "fp", "h", "key", "rate", "component_id", "c0", "n0")]])
    return spark.createDataFrame([(*r, *["clash"] * 13) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return spark.createDataFrame([], odd.schema)
