"""Calendars as expressions on a date, and as generated dimensions for a caller's range of years."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FISCAL_START_MONTH = 2


def _retail_year_start(year):
    """Day after the Saturday closest to 31 January."""
    anchor = F.make_date(year, F.lit(1), F.lit(31))
    since_saturday = F.dayofweek(anchor) % 7
    shift = F.when(since_saturday <= 3, -since_saturday).otherwise(7 - since_saturday)
    return F.date_add(anchor, shift + 1)


def retail_month_of(day: Column) -> Column:
    """First day of the calendar month that stands for the 4-5-4 month of a date, whatever its year.

    A quarter has 13 weeks in months of 4, 5 and 4; a 53rd week belongs to the last month.
    """
    year = F.when(day >= _retail_year_start(F.year(day)), F.year(day)).otherwise(F.year(day) - 1)
    week = F.floor(F.date_diff(day, _retail_year_start(year)) / 7).cast("int")
    quarter = F.least(F.floor(week / 13).cast("int"), F.lit(3))
    week = week - 13 * quarter
    place = F.when(week < 4, 0).when(week < 9, 1).otherwise(2)
    return F.add_months(F.make_date(year, F.lit(2), F.lit(1)), 3 * quarter + place)


def retail_month_number(month: Column) -> Column:
    """Number from 1 of a 4-5-4 month given by its calendar month."""
    return F.month(F.add_months(month, -1))


def retail_month_columns(month: Column) -> dict[str, Column]:
    """Bounds and numbers of a 4-5-4 month, its quarter and its year."""
    year = F.year(F.add_months(month, -1))
    number = retail_month_number(month)
    position = (number - 1) % 3
    quarter = F.floor((number - 1) / 3).cast("int") + 1
    year_start = _retail_year_start(year)
    year_end = F.date_add(_retail_year_start(year + 1), -1)
    quarter_start = F.date_add(year_start, 91 * (quarter - 1))
    start = F.date_add(quarter_start, 7 * F.when(position == 0, 0).when(position == 1, 4).otherwise(9))
    return {
        "retail_month_start": start,
        "retail_month_end": F.when(number == 12, year_end).otherwise(F.date_add(start, F.when(position == 1, 34).otherwise(27))),
        "retail_month_number": number,
        "retail_quarter_start": quarter_start,
        "retail_quarter_end": F.when(quarter == 4, year_end).otherwise(F.date_add(quarter_start, 90)),
        "retail_quarter_rank": quarter,
        "retail_year_start": year_start,
        "retail_year_end": year_end,
        "retail_year": year,
    }


def retail_months(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """4-5-4 calendar of some years, one row per retail month."""
    years = spark.range(first_year, last_year + 1).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(11))))
    month = F.add_months(F.make_date(F.col("id").cast("int"), F.lit(2), F.lit(1)), F.col("number"))
    months = years.select(month.alias("retail_month_for_trailing"))
    return months.select("*", *[c.alias(name) for name, c in retail_month_columns(F.col("retail_month_for_trailing")).items()])


def retail_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The same calendar, one row per day."""
    months = retail_months(spark, first_year, last_year)
    return months.withColumn("cal_day", F.explode(F.sequence("retail_month_start", "retail_month_end")))


def fiscal_quarter_of(day: Column) -> tuple[Column, Column]:
    """Fiscal year and quarter label (``1Q24``) of a date; the first quarter starts on 1 February."""
    shifted = F.add_months(day, 1 - FISCAL_START_MONTH)
    year = F.year(shifted).cast("string")
    return year, F.concat(F.quarter(shifted).cast("string"), F.lit("Q"), F.substring(year, 3, 2))


def fiscal_quarters(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Interval rows (year, qtr, start_date, end_date); the first quarter starts on 1 February."""
    quarters = spark.range(first_year, last_year + 1).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    first_day = F.make_date(F.col("id").cast("int"), F.lit(FISCAL_START_MONTH), F.lit(1))
    start = F.add_months(first_day, 3 * F.col("q"))
    return quarters.select(
        F.col("id").cast("int").alias("year"),
        F.concat((F.col("q") + 1).cast("string"), F.lit("Q"), F.substring(F.col("id").cast("string"), 3, 2)).alias("qtr"),
        start.alias("start_date"),
        F.date_add(F.add_months(start, 3), -1).alias("end_date"),
    )


def month_start(day: dt.date | str) -> dt.date:
    """A start date moved to the first of its month, which the month-keyed series need."""
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return day.replace(day=1)
