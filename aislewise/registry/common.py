"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.sources.items import filter_items
from aislewise.sources.tables import Tables

START_DATE = "1995-01-01"


def at(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, folder=sf_dir)


def dates(tables: Tables) -> DataFrame:
    """Order dates of the item base, the cheapest frame that knows the newest one."""
    return filter_items(tables, ["order_date"])


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare by value across engines."""
    as_double = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(as_double) if as_double else df


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
