"""Product marts: period comparison, time series, scorecard and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.labels import sample_risk
from aislewise.functions.measures import ratio
from aislewise.functions.periods import floor_to
from aislewise.operators.grouping import null_safe_join, scalar
from aislewise.sources.items import with_optional

KEYS = (
    "channel", "major_cat", "sub_cat", "minor_cat", "web_description", "merchant", "brand", "sub_brand", "product_id",
)
OPTIONAL = (
    "product_hash", "parent_sku", "parent_sku_name", "variation_sku", "variation_sku_name", "parent_brand", "product_url",
)
ITEM_COLUMNS = (
    "order_date", "month", "channel", "major_cat", "sub_cat", "minor_cat", "web_description", "merchant_clean", "brand",
    "sub_brand", "parent_brand", "product_id", "item_price", "item_quantity", "gmv",
)
INTERVALS = ("Last Year", "Year-To-Date", "Last Quarter", "Last Month", "Trailing 12 Months")


def _unpacked(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    names = [f"__attr_{a}" for a in attributes]
    if not attributes:
        return df
    packed = F.struct(*[F.col(n).alias(a) for n, a in zip(names, attributes)])
    return df.withColumn("product_attributes", F.parse_json(F.to_json(packed))).drop(*names)


# The same keys in the order of sorting: the product, a number of many values, tells rows apart at the first comparison.
BY_PRODUCT = ("product_id", *[k for k in KEYS if k != "product_id"])
SUMS = ("total_spend", "total_units", "gmv", "observations")
# Lots that product keys are dealt to. A lot is worked on by one task, so many lots keep its memory small.
PRODUCT_PARTS = 256


def _texts(items: DataFrame, attributes: Sequence[str]) -> dict[str, str]:
    """Text columns that are reduced to their smallest value: output name and item column.

    Attributes travel as parts, since a variant can be neither grouped nor compared.
    """
    present = {c: c for c in OPTIONAL if c in items.columns}
    return present | {f"__attr_{a}": a for a in attributes}


def _monthly(items: DataFrame, attributes: Sequence[str], dealt: bool) -> DataFrame:
    """The one aggregate behind all product marts: metrics per product key and month.

    The smallest text of a group needs a sort-based aggregate. Items are therefore first summed with the
    texts as extra keys, which hashing can do, and only the sums are sorted. Items are dealt by product before
    that, the only shuffle: it keeps whole product keys together, as all later aggregates and windows need it.
    Items that come ``dealt`` by ``product_id`` already have that and stay where they are.
    """
    texts = _texts(items, attributes)
    described = items.filter(F.col("web_description").isNotNull())
    keyed = described.drop("merchant")
    keyed = keyed.withColumnRenamed("merchant_clean", "merchant")
    keyed = keyed if dealt else keyed.repartition(PRODUCT_PARTS, *KEYS)
    hashed = keyed.groupBy(*BY_PRODUCT, "month", *[F.col(c).alias(f"{out}__") for out, c in texts.items()]).agg(
        F.sum(F.col("item_price") * F.col("item_quantity")).alias("total_spend"),
        F.sum("item_quantity").alias("total_units"),
        F.sum("gmv").alias("gmv"),
        F.count(F.lit(1)).alias("observations"),
        F.min("order_date").alias("first_observation_in_month"),
        F.max("order_date").alias("last_observation_in_month"),
    )
    return hashed.groupBy(*BY_PRODUCT, "month").agg(
        *[F.min(f"{out}__").alias(out) for out in texts],
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("first_observation_in_month").alias("first_observation_in_month"),
        F.max("last_observation_in_month").alias("last_observation_in_month"),
    )


def _window_lags(df: DataFrame, season: Sequence[str], order: str, first_keys: Sequence[str]) -> DataFrame:
    """Metrics of the period before, and whether the period is the first of its product.

    The first period is the smallest of the group, which needs no second sort next to the seasonal one.
    """
    by_season = Window.partitionBy(*first_keys, *season).orderBy(order)
    whole = Window.partitionBy(*first_keys)
    return df.withColumns(
        {
            "last_obs": F.lag("observations").over(by_season),
            "last_gmv": F.lag("gmv").over(by_season),
            "new_sku_flag": (F.col(order) == F.min(order).over(whole)).cast("int"),
        }
    )


def sku_time_series(
    items: DataFrame, attributes: Sequence[str] = (), product_id_type: str = "sku", dates: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """One row per product key and month with the month before it and the first-appearance flag."""
    last = floor_to("month", scalar(items if dates is None else dates, F.max("order_date")))
    series = _window_lags(_monthly(items, attributes, dealt), (), "month", BY_PRODUCT)
    series = series.withColumns(
        {
            "product_id_type": F.lit(product_id_type),
            "display_interval": F.lit("Monthly Time Series"),
            "period_starting": F.col("month"),
            "max_date": last,
        }
    ).withColumnRenamed("month", "period_month")
    ordered = series.select(*KEYS, *[c for c in series.columns if c not in KEYS])
    return _unpacked(with_optional(ordered, OPTIONAL), attributes)


def _placements(month: Column, last: Column) -> dict[str, Column]:
    """For each interval: the period a month counts towards, as (period, season, order), or NULL."""
    def slot(period, season, order):
        return F.struct(
            period.cast("date").alias("period"), season.cast("int").alias("season"), order.cast("date").alias("order")
        )

    none = F.lit(0)
    year, quarter = floor_to("year", month), floor_to("quarter", month)
    recent = F.add_months(last, -11)
    older = F.add_months(last, -23)
    return {
        "Last Year": F.when(year < floor_to("year", last), slot(year, none, year)),
        "Year-To-Date": F.when(F.month(month) <= F.month(last), slot(year, none, year)),
        "Last Quarter": F.when(quarter < floor_to("quarter", last), slot(quarter, F.quarter(month), quarter)),
        "Last Month": slot(month, F.month(month), month),
        # Both halves are labelled with the start of the newest twelve months.
        "Trailing 12 Months": F.when(
            month >= older, slot(recent, none, F.when(month >= recent, recent).otherwise(older))
        ),
    }


def _shown_period(last: Column) -> dict[str, Column]:
    """The period each interval reports (compared with the ordering date of a row)."""
    return {
        "Last Year": F.add_months(floor_to("year", last), -12),
        "Year-To-Date": floor_to("year", last),
        "Last Quarter": F.add_months(floor_to("quarter", last), -3),
        "Last Month": last,
        "Trailing 12 Months": F.add_months(last, -11),
    }


def _reported_max(interval: Column, last: Column) -> Column:
    return (
        F.when(interval == "Last Year", F.add_months(floor_to("year", last), -1))
        .when(interval == "Last Quarter", F.date_add(floor_to("quarter", last), -1))
        .otherwise(last)
    )


def sku_analysis(
    items: DataFrame,
    intervals: Sequence[str] = INTERVALS,
    attributes: Sequence[str] = (),
    product_id_type: str = "sku",
    dates: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Latest period of each interval next to the comparable period before it.

    The monthly aggregate is read once: each month is repeated under the intervals it belongs to and
    summed again, then one window per key and interval finds the previous period. A month is repeated
    only under intervals whose reported period the product sold in, as no other row can be reported.

    "Last Year" and "Last Quarter" report the last complete year and quarter. Asking for the running
    one, after having kept only earlier ones, would always be empty. ``max_date`` is the last month (or,
    for the quarter, day) of the reported data.
    """
    last = floor_to("month", scalar(items if dates is None else dates, F.max("order_date")))
    month = F.col("month")
    placed, shown_at = _placements(month, last), _shown_period(last)
    monthly = _monthly(items, attributes, dealt).drop("first_observation_in_month", "last_observation_in_month")
    by_key = Window.partitionBy(*BY_PRODUCT)
    sold = {
        f"__sold_{i}": F.bool_or(placed[name]["order"] == shown_at[name]).over(by_key) for i, name in enumerate(intervals)
    }
    slots = F.array(
        *[
            F.when(
                F.col(f"__sold_{i}") & placed[name].isNotNull(),
                F.struct(F.lit(name).alias("display_interval"), placed[name].alias("at")),
            )
            for i, name in enumerate(intervals)
        ]
    )
    flagged = monthly.withColumns(sold)
    spread = flagged.withColumn("__slot", F.explode(slots)).filter(F.col("__slot").isNotNull()).select(
        "*",
        F.col("__slot.display_interval").alias("display_interval"),
        F.col("__slot.at.period").alias("period_starting"),
        F.col("__slot.at.season").alias("__season"),
        F.col("__slot.at.order").alias("__order"),
    )
    # Still partitioned by product key: neither this aggregate nor the window below moves a row.
    summed = spread.groupBy(*BY_PRODUCT, "display_interval", "__season", "__order", "period_starting").agg(
        *[F.min(c).alias(c) for c in _texts(items, attributes)], *[F.sum(c).alias(c) for c in SUMS]
    )
    lagged = _window_lags(summed, ["__season"], "__order", [*BY_PRODUCT, "display_interval"])
    reported = F.coalesce(*[F.when(F.col("display_interval") == name, at) for name, at in shown_at.items()])
    shown = lagged.filter(F.col("__order") == reported)
    shown = shown.withColumns(
        {"product_id_type": F.lit(product_id_type), "max_date": _reported_max(F.col("display_interval"), last)}
    )
    ordered = shown.select(*KEYS, *[c for c in shown.columns if c not in (*KEYS, "__season", "__order")])
    return _unpacked(with_optional(ordered, OPTIONAL), attributes)


def sku_scorecard(analysis: DataFrame) -> DataFrame:
    """Per product: units for the market, selling price, sample risk and growth where the sample allows it."""
    grouped = analysis.groupBy("merchant", "brand", "web_description", "product_id").agg(
        F.min("major_cat").alias("major_category"),
        F.min("sub_cat").alias("sub_category"),
        F.min("minor_cat").alias("minor_category"),
        F.sum("gmv").alias("total_gmv"),
        F.sum("last_obs").alias("sum_last_obs"),
        F.sum("last_gmv").alias("last_year_gmv"),
        ratio(F.sum("total_spend"), F.sum("total_units")).alias("asp"),
        F.sum("observations").alias("sample_size"),
        F.min("product_hash").alias("product_hash"),
    )
    growth = ratio(F.col("total_gmv"), F.col("last_year_gmv")) - 1
    enough = (F.col("sample_size") > 1000) & (F.col("sum_last_obs") > 500)
    return grouped.withColumns(
        {
            "units": F.try_divide(F.col("total_gmv").cast("double"), F.col("asp")),
            "ssr": sample_risk(F.col("sample_size")),
            "yoy_growth": F.when(enough, growth),
        }
    )


def product_hash(description: Column, brand: Column, merchant: Column, sku: Column) -> Column:
    """Product identity: md5 of the texts that describe it, missing ones counted as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (description, brand, merchant, sku)]
    return F.md5(F.concat(*parts))


def find_product(items: DataFrame, digest: str) -> DataFrame:
    """Rows of the product with the given hash."""
    hashed = product_hash(F.col("web_description"), F.col("brand"), F.col("merchant"), F.col("sku"))
    return items.withColumn("product_hash", hashed).filter(F.col("product_hash") == digest)


def first_seen(items: DataFrame) -> DataFrame:
    """First order date per product."""
    return items.groupBy("sku").agg(F.min("order_date").alias("first_appearance"))


def _label_missing_description(items: DataFrame) -> DataFrame:
    return items.withColumn("web_description", F.coalesce("web_description", F.lit("no_web_description")))


def reconcile_gmv(items: DataFrame, share: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Latest month by merchant and category: item totals, product totals and market-share totals.

    Product totals skip items without a description; ``undescribed_gmv`` is what that leaves out.
    """
    last = floor_to("month", scalar(items if dates is None else dates, F.max("order_date")))
    keys = ["merchant", "major_cat"]
    missing = F.col("web_description") == "no_web_description"
    by_item = (
        _label_missing_description(items.filter(F.col("month") == last))
        .groupBy(F.col("merchant_clean").alias("merchant"), "major_cat")
        .agg(
            F.sum("gmv").alias("item_gmv"),
            F.sum(F.when(~missing, F.col("gmv"))).alias("sku_gmv"),
            F.coalesce(F.sum(F.when(missing, F.col("gmv"))), F.lit(0).cast("decimal(28,4)")).alias("undescribed_gmv"),
        )
    )
    by_share = share.filter(F.col("trunc_day") == last).groupBy(*keys).agg(F.sum("gmv").alias("share_gmv"))
    both = null_safe_join(by_item, by_share, keys, "left")
    return both.withColumn("gmv_gap", F.col("share_gmv") - F.col("sku_gmv"))
