"""Quarterly report marts: rolling-quarter views, brand chart, scorecards, competitor share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions import labels
from aislewise.functions.measures import ratio
from aislewise.functions.predicates import page_filter
from aislewise.operators.calendar_join import interval_join
from aislewise.operators.grouping import label_others, last_periods, rolling_periods, top_ranked
from aislewise.sources.calendars import fiscal_quarter_of

QUARTERS_SHOWN = 17
TOP_SHOWN = 15
FOCUS_WEIGHT = 10000000


def quarter_of(fiscal_year: Column, fiscal_qtr: Column) -> Column:
    """``'2024'`` and ``'3Q24'`` give ``'2024 3Q'``."""
    return F.concat(F.substring(fiscal_year, 1, 4), F.lit(" "), F.substring(fiscal_qtr, 1, 2))


def with_fiscal_quarter(items: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Add ``fiscal_year`` and ``fiscal_qtr`` of the order date: by rule, or of the interval of a given calendar."""
    if calendar is None:
        year, quarter = fiscal_quarter_of(F.col("order_date"))
        return items.withColumns({"fiscal_qtr": quarter, "fiscal_year": year})
    named = calendar.select(
        F.col("qtr").alias("fiscal_qtr"), F.col("year").cast("string").alias("fiscal_year"), "start_date", "end_date"
    )
    return interval_join(items, named, "order_date", "start_date", "end_date").drop("start_date", "end_date")


REPORT_KEYS = ("department", "class", "sub_class", "merchant", "channel", "brand", "source")


def quarterly_report(items: DataFrame, by: Sequence[str] = REPORT_KEYS) -> DataFrame:
    """Quarterly totals per department, class, sub-class, merchant, channel, brand and source, or per fewer of these."""
    named = {"department": F.col("major_cat"), "class": F.col("sub_cat"), "sub_class": F.coalesce("finish", F.lit("N/A"))}
    dated = with_fiscal_quarter(items).withColumns({k: c for k, c in named.items() if k in by})
    return dated.groupBy("fiscal_year", "fiscal_qtr", *by).agg(
        F.sum("gmv").alias("gmv"), F.sum("item_quantity").alias("units"), F.count(F.lit(1)).alias("sample_size")
    )


def _reported(report: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    prepared = report.withColumns(
        {
            "quarter": quarter_of(F.col("fiscal_year"), F.col("fiscal_qtr")),
            "sub_class": F.when(F.col("sub_class") == "N/A", "OTHER PRODUCTS").otherwise(F.col("sub_class")),
        }
    )
    placed = prepared.dropna(subset=["quarter", "department", "merchant", "channel"])
    return page_filter(placed, {"source": sources})


def _final_merchant(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace the raw merchant by its final name. Sums are additive, so this may precede them."""
    named = mapping.select(F.col("merchant").alias("__raw"), "final_name")
    joined = facts.join(named, F.col("merchant") == F.col("__raw"), "left").drop("__raw", "merchant")
    return joined.withColumnRenamed("final_name", "merchant")


def report_quarters(report: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Quarters present in the report."""
    return page_filter(report, {"source": sources}).select(
        quarter_of(F.col("fiscal_year"), F.col("fiscal_qtr")).alias("quarter")
    ).distinct()


def _rolling_view(
    report: DataFrame,
    mapping: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    sources: Sequence[str] | None,
    last_quarter: str | None,
) -> DataFrame:
    sums = {src: F.sum(src).alias(src) for src in values.values()}
    reported = _final_merchant(_reported(report, sources).withColumn("clean_brand", labels.clean_brand(F.col("brand"))), mapping)
    facts = reported.groupBy("quarter", *keys).agg(*sums.values()).filter(F.col("gmv").isNotNull())
    rolled = rolling_periods(facts, report_quarters(report), keys, "quarter", values, 4)
    if last_quarter is not None:
        rolled = rolled.filter(F.col("quarter") <= last_quarter)
    return rolled.withColumn("channel", labels.channel_title(F.col("channel")))


def brand_view(
    report: DataFrame, mapping: DataFrame, sources: Sequence[str] | None = None, last_quarter: str | None = None
) -> DataFrame:
    """Rolling four-quarter gmv per department, class, sub-class, channel, merchant and brand."""
    keys = ["department", "class", "sub_class", "channel", "merchant", "clean_brand"]
    return _rolling_view(report, mapping, keys, {"rolling_merchant_gmv": "gmv"}, sources, last_quarter)


def competitor_base(
    report: DataFrame, mapping: DataFrame, sources: Sequence[str] | None = None, last_quarter: str | None = None
) -> DataFrame:
    """Rolling four-quarter gmv, units and sample per merchant, channel and category."""
    keys = ["merchant", "channel", "department", "class", "sub_class"]
    values = {"gmv": "gmv", "units": "units", "sample_size": "sample_size"}
    return _rolling_view(report, mapping, keys, values, sources, last_quarter)


def _chart(
    source: DataFrame,
    name: str,
    value: str,
    weight: Column,
    other: str,
    choices: Mapping[str, Sequence],
    quarters: int,
    top: int,
) -> DataFrame:
    """Share per quarter of the top names, everything else pooled.

    Names are ranked over the whole source; quarters and page choices narrow only what is shown. The
    source is first summed to what the chart can distinguish; the later steps share that aggregate's exchange.
    """
    dims = list(dict.fromkeys([name, "quarter", *choices]))
    small = source.groupBy(*dims).agg(F.sum(value).alias("__value"))
    kept = top_ranked(small, name, weight, top)
    shown_quarters = last_periods(small, "quarter", quarters)
    shown = page_filter(small, choices).join(shown_quarters, "quarter", "left_semi")
    named = label_others(shown, kept, name, other)
    # At most the shown names by the shown quarters: windows over this keep the plan to one copy of the source.
    by_quarter = named.groupBy(name, "quarter").agg(F.sum("__value").alias("__sum"))
    return by_quarter.withColumns(
        {
            "__quarter_total": F.sum("__sum").over(Window.partitionBy("quarter")),
            "__name_total": F.sum("__sum").over(Window.partitionBy(name)),
        }
    )


def brand_chart(
    view: DataFrame,
    source_choices: Mapping[str, Sequence] | None = None,
    choices: Mapping[str, Sequence] | None = None,
    quarters: int = QUARTERS_SHOWN,
    top: int = TOP_SHOWN,
    limit: int | None = None,
) -> DataFrame:
    """Share of the top brands per quarter; brands outside the top are pooled.

    ``source_choices`` decide which rows are ranked, ``choices`` (channel, quarter) only what is shown.
    """
    source = page_filter(view, source_choices or {})
    chart = _chart(
        source, "clean_brand", "rolling_merchant_gmv", F.sum("__value"), labels.OTHER_BRANDS, choices or {}, quarters, top
    )
    rows = (
        chart.select(
            F.col("clean_brand").alias("brand_name"),
            F.col("__name_total").alias("brand_total_gmv"),
            "quarter",
            ratio(F.col("__sum"), F.col("__quarter_total")).alias("brand_share"),
        )
        .orderBy("brand_total_gmv", "brand_name", "quarter")
    )
    return rows if limit is None else rows.limit(limit)


def _focus_weight(focus: str) -> Column:
    """Total of a merchant, raised for the focus merchant so that it always ranks first."""
    boosted = F.when(F.first("merchant") == focus, FOCUS_WEIGHT).otherwise(1)
    return F.sum("__value").cast("double") * boosted


def competitor_share(
    base: DataFrame,
    focus: str,
    source_choices: Mapping[str, Sequence] | None = None,
    choices: Mapping[str, Sequence] | None = None,
    quarters: int = QUARTERS_SHOWN,
    top: int = TOP_SHOWN,
    limit: int | None = None,
) -> DataFrame:
    """Rolling market share of the top retailers per quarter, the focus retailer always among them."""
    source = page_filter(base, source_choices or {})
    chart = _chart(
        source, "merchant", "gmv", _focus_weight(focus), labels.OTHER_RETAILERS, choices or {}, quarters, top
    )
    rows = (
        chart.select(
            F.col("merchant").alias("retailer_name"),
            F.col("__name_total").alias("retailer_total_gmv"),
            "quarter",
            ratio(F.col("__sum"), F.col("__quarter_total")).alias("market_share"),
        )
        .orderBy("retailer_total_gmv", "retailer_name", "quarter")
    )
    return rows if limit is None else rows.limit(limit)


def scorecard(
    view: DataFrame,
    value: str = "rolling_merchant_gmv",
    choices: Mapping[str, Sequence] | None = None,
    quarter: str | None = None,
) -> DataFrame:
    """One number: the market size of the chosen rows in a quarter, the latest one by default."""
    source = page_filter(view, choices or {})
    if quarter is None:
        shown = source.filter(F.col("quarter") == source.agg(F.max("quarter")).scalar())
    else:
        shown = source.filter(F.lower("quarter") == quarter.lower())
    return shown.agg(F.sum(value).alias("market_size"))
