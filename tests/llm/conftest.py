from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", 1.0, "x"),
        (2, "the quick  brown fox\njumps over the lazy dog and runs away.", None, None, None),
        (2, "the quick  brown fox\njumps over the lazy dog and runs away.", None, None, None),
        (3, None, "en", 0.0, "y"),
        (4, "", "en", 0.0, "y"),
        (5, "   \n\t ", "en", 0.0, "y"),
        (None, "no id here at all", None, None, None),
        (None, None, None, None, None),
        (6, long, "en", 0.5, "z"),
        (7, "▁ own mark, été \U0001f600 \x00 end", "fr", 0.5, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, component_id string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
