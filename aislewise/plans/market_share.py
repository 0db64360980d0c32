"""Market-share marts on the standard and on the 4-5-4 calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.functions import labels
from aislewise.functions.measures import implied_units, metric
from aislewise.functions.periods import DISPLAY_INTERVALS, end_of, floor_to
from aislewise.operators.densify import fill_months, running_totals, trailing_from_totals
from aislewise.operators.grouping import ITEM_METRICS, hier_agg, largest
from aislewise.sources.calendars import month_start, retail_month_columns, retail_month_number, retail_month_of

KEYS = (
    "channel", "parent_brand", "brand", "sub_brand", "merchant", "major_cat", "sub_cat", "minor_cat",
    "special_attribute",
)

# Item columns the marts read; callers use it to prune the item base.
ITEM_COLUMNS = (
    "order_date", "channel", "parent_brand", "brand", "sub_brand", "merchant_clean", "major_cat", "sub_cat",
    "minor_cat", "gmv", "item_price", "item_quantity",
)

CALENDAR_COLUMNS = (
    "date", "month_start", "month_end", "month", "quarter_start", "quarter_end", "quarter", "year_start", "year_end",
    "year", "max_month", "max_quarter", "max_date",
)

METRIC_COLUMNS = (
    "gmv", "units", "sample_size", "item_subtotal_observed", "item_quantity_observed",
    *[f"{m}_trailing_{s}m" for m in ("gmv", "units", "sample_size") for s in (3, 6, 12)],
)


def display_interval_table(spark: SparkSession) -> DataFrame:
    """The list of display intervals published next to the marts."""
    return spark.createDataFrame([(name,) for name in DISPLAY_INTERVALS], "display_interval string")


def attribute_columns(special_attributes: Iterable[str]) -> list[str]:
    """Attributes to publish: the caller's list without repeats, then the major category."""
    return list(dict.fromkeys([*special_attributes, "major_cat"]))


def _share_keys(
    items: DataFrame, attribute: str, name_missing: bool, name_missing_merchant: bool, also: Iterable[str] = ()
) -> DataFrame:
    """Key columns of the marts, and ``also`` others. ``name_missing`` labels missing brands; merchants have their own switch."""
    special = F.coalesce(F.col(attribute).cast("string"), F.col("major_cat")).alias("special_attribute")
    brands = [
        labels.brand_or(labels.UNBRANDED, F.col(b)).alias(b) if name_missing else F.col(b)
        for b in ("parent_brand", "brand", "sub_brand")
    ]
    merchant = F.col("merchant_clean")
    if name_missing_merchant:
        merchant = F.coalesce(merchant, F.lit(labels.NO_MERCHANT))
    plain = ["order_date", "channel", "major_cat", "sub_cat", "minor_cat", "gmv", "item_price", "item_quantity"]
    return items.select(*also, *plain, special, *brands, merchant.alias("merchant"))


def monthly_series(
    items: DataFrame,
    attribute: str,
    first: dt.date | None,
    calendar: str,
    name_missing: bool,
    name_missing_merchant: bool,
    also: Iterable[str] = (),
) -> tuple[DataFrame, Column]:
    """Observed monthly metrics per key, and per ``also`` if given, from ``first`` on, and the last month of the whole table."""
    keyed = _share_keys(items, attribute, name_missing, name_missing_merchant, also)
    if calendar == "454":
        dated = keyed.withColumn("date", retail_month_of(F.col("order_date")))
    else:
        dated = keyed.withColumn("date", floor_to("month", F.col("order_date")))
    monthly = hier_agg(dated, [*also, "date", *KEYS])
    if first is not None:
        monthly = monthly.filter(F.col("date") >= F.lit(first))
    return monthly, largest(monthly, "date")


def market_share_dense(items: DataFrame, attribute: str = "major_cat", start_date=None) -> DataFrame:
    """First-generation mart: gap-filled monthly metrics keyed by ``trunc_day``, no trailing sums."""
    first = month_start(start_date) if start_date is not None else None
    monthly, last = monthly_series(items, attribute, first, "standard", False, False)
    dense = fill_months(monthly, KEYS, "date", ITEM_METRICS, last, first)
    return dense.withColumnRenamed("date", "trunc_day")


def market_share(
    items: DataFrame,
    attribute: str = "major_cat",
    start_date: dt.date | str | None = None,
    calendar: str = "standard",
) -> DataFrame:
    """Market-share mart for one attribute on the ``standard`` or the ``454`` calendar.

    ``max_month`` and ``max_quarter`` are those of the last month on the standard calendar. On the 4-5-4
    calendar they are the largest numbers that occur in the mart; since the key that sells in the last
    month always spans the twelve months before it (or all months since ``start_date``), the calendar
    alone answers that.
    """
    first = month_start(start_date) if start_date is not None else None
    monthly, last = monthly_series(items, attribute, first, calendar, True, calendar == "standard")
    return with_calendar(rolled(monthly, last, first), last, first, calendar)


def rolled(monthly: DataFrame, last: Column, first: dt.date | None) -> DataFrame:
    """Gap-filled months of observed ``monthly`` rows with their trailing sums, without calendar columns."""
    units = implied_units(F.col("gmv"), F.col("item_subtotal_observed"), F.col("item_quantity_observed"))
    summed = ("gmv", "units", "sample_size")
    # Totals run over observed months; added months repeat them, so the gaps add no summing.
    totals, running = running_totals(monthly.withColumn("units", metric(units)), KEYS, "date", summed, ["units"])
    dense = fill_months(totals, KEYS, "date", ITEM_METRICS, last, first, blank=["units"], carry=running)
    trailing = trailing_from_totals(dense, KEYS, "date", summed, may_be_null=["units"])
    counts = {"item_quantity_observed", *[c for c in METRIC_COLUMNS if c.startswith("sample_size")]}
    metrics = [
        (F.col(c).cast("int") if c in counts else metric(F.col(c))).alias(c) for c in METRIC_COLUMNS
    ]
    return trailing.select("date", *KEYS, *metrics)


def with_calendar(mart: DataFrame, last: Column, first: dt.date | None, calendar: str) -> DataFrame:
    """The published columns of :func:`rolled` rows of a table whose last month is ``last``."""
    date = F.col("date")
    if calendar == "454":
        reach = F.add_months(last, -11)
        since = retail_month_number(reach if first is None else F.greatest(reach, F.lit(first)))
        # Months that pass a year's end hold its last one.
        newest = F.when(since > retail_month_number(last), 12).otherwise(retail_month_number(last))
        named = {"retail_month_number": "month", "retail_quarter_rank": "quarter"}
        dated = mart.withColumns(
            {named.get(name, name.replace("retail_", "")): c for name, c in retail_month_columns(date).items()}
            | {"max_month": newest, "max_quarter": F.ceil(newest / 3).cast("int"), "max_date": last}
        )
    else:
        dated = mart.withColumns(
            {
                "month_start": date,
                "month_end": F.last_day(date),
                "month": F.month(date),
                "quarter_start": floor_to("quarter", date),
                "quarter_end": end_of("quarter", date),
                "quarter": F.quarter(date),
                "year_start": floor_to("year", date),
                "year_end": end_of("year", date),
                "year": F.year(date),
                "max_month": F.month(last),
                "max_quarter": F.quarter(last),
                "max_date": last,
            }
        )
    order = ("parent_brand", "brand", "sub_brand", "major_cat", "sub_cat", "minor_cat", "merchant", "channel",
             "special_attribute")
    return dated.select(*CALENDAR_COLUMNS, *order, *METRIC_COLUMNS)


def market_share_tables(items: DataFrame, special_attributes: Iterable[str] = (), start_date=None) -> dict[str, DataFrame]:
    """All mart tables of one demo, stamped with the time they were built.

    Keys are the published table suffixes; the major-category mart is the one called ``null``.
    """
    out = {}
    for column in attribute_columns(special_attributes):
        suffix = "null" if column == "major_cat" else column
        for calendar, label in (("standard", "standard_calendar"), ("454", "454_calendar")):
            mart = market_share(items, column, start_date, calendar)
            out[f"market_share_for_column_{suffix}_{label}"] = mart.withColumn(
                "_updated_timestamp", F.current_timestamp()
            )
        out[f"market_share_for_column_{suffix}"] = market_share_dense(items, column, start_date)
    return out
