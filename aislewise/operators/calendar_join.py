"""Placing dated rows into calendar intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(
    rows: DataFrame, intervals: DataFrame, day: str, start: str, end: str
) -> DataFrame:
    """Left join on ``day BETWEEN start AND end`` as an equi join.

    The intervals are opened to one row per day, so the join is hashed on the day instead of comparing
    every row with every interval. Overlapping intervals match more than once, as the range join would.
    A short calendar is broadcast by Spark itself; with a long one AQE splits days that many rows fall on.
    """
    days = intervals.withColumn("__day", F.explode(F.sequence(start, end)))
    return rows.join(days, F.col(day) == F.col("__day"), "left").drop("__day")
