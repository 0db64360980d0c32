"""Shopper marts: panel membership and shopper metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.labels import age_cohort, age_cohort_title
from aislewise.functions.measures import ratio
from aislewise.functions.periods import floor_to
from aislewise.functions.predicates import page_filter
from aislewise.operators.grouping import scalar

YEAR_VIEWS = ("Annual", "Year-To-Date")
CURRENT_YEAR = "Year-To-Date (Current Year)"
_GRAIN = {"Monthly": "month", "Quarterly": "quarter"}


def shopper_enriched(
    items: DataFrame,
    rolling_users: DataFrame,
    annual_users: DataFrame,
    rolling_weights: DataFrame,
    annual_weights: DataFrame,
) -> DataFrame:
    """Items with panel membership, panel sizes, age cohort and household-size weights.

    ``panel_flag_test``: 1 active in the rolling period and the year, 2 rolling period only, 3 year only.
    """
    rolling_size = scalar(rolling_users, F.count_distinct("user_id"))
    annual_size = annual_users.groupBy(F.col("year").alias("__year")).agg(
        F.count_distinct("user_id").alias("annual_active_users")
    )
    members = annual_users.select(F.col("user_id").alias("__user"), F.col("year").alias("__member_year")).distinct()
    in_year = F.col("__user").isNotNull()
    flag = (
        F.when((F.col("panel_flag") == 1) & in_year, 1).when(F.col("panel_flag") == 1, 2).when(in_year, 3)
    )
    users = (
        items.join(
            members, (F.col("user_id") == F.col("__user")) & (F.col("year") == F.col("__member_year")), "left"
        )
        .join(annual_size, F.col("year") == F.col("__year"), "left")
        .withColumns(
            {
                "panel_flag_test": flag,
                "rolling_active_users": rolling_size,
                "age_cohort": age_cohort(F.col("age")),
            }
        )
        .drop("__user", "__member_year", "__year")
    )
    for weights, name in ((rolling_weights, "age_adj_2yr"), (annual_weights, "age_adj_annual")):
        factor = weights.select(
            F.col("year").alias("__wyear"), F.col("age_cohort").alias("__cohort"), F.col("hh_size_adj_factor").alias(name)
        )
        same = (F.year("year").cast("string") == F.col("__wyear")) & (F.col("age_cohort") == F.col("__cohort"))
        users = users.join(factor, same, "left").drop("__wyear", "__cohort")
    return users


def shopper_metrics(
    enriched: DataFrame,
    interval: str = "Monthly",
    choices: Mapping[str, Sequence] | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Buyers, trips and spend per period turned into buy rate, frequency, penetration and shoppers.

    Period and cohort are counted first, then cohorts are weighted and pooled. ``as_of`` picks the year
    shown by the current-year view.
    """
    last = scalar(enriched, F.max("month"))
    month = F.col("month")
    shown = page_filter(enriched, choices or {})
    if interval == "Year-To-Date":
        shown = shown.filter(F.month(month) <= F.month(last))
    by_year = interval in YEAR_VIEWS
    eligible = F.col("panel_flag_test").isin([1, 3] if by_year else [1, 2])
    only = lambda c: F.when(eligible, c)
    by_cohort = (
        shown.select(
            floor_to(_GRAIN.get(interval, "year"), month).alias("month"),
            age_cohort_title(F.col("age")).alias("cohort"),
            only(F.col("item_price") * F.col("item_quantity")).alias("spend"),
            only(F.col("user_id")).alias("buyer"),
            only(F.col("order_id")).alias("trip"),
            only(F.col("item_quantity")).alias("quantity"),
            "gmv",
            F.col("annual_active_users" if by_year else "rolling_active_users").alias("active_users"),
            F.col("age_adj_annual" if by_year else "age_adj_2yr").alias("age_adj"),
        )
        .groupBy("month", "cohort")
        .agg(
            F.sum("spend").alias("spend"),
            F.count_distinct("buyer").alias("buyers"),
            F.count_distinct("trip").alias("trips"),
            F.sum("quantity").alias("quantity"),
            F.sum("gmv").alias("gmv"),
            F.max("active_users").alias("active_users"),
            F.coalesce(F.max("age_adj"), F.lit(1)).alias("age_adj"),
        )
    )
    if not by_year:
        by_cohort = by_cohort.filter(month >= F.add_months(last, -24))
    pooled = by_cohort.groupBy("month").agg(
        ratio(F.sum("spend"), F.sum("buyers")).alias("buy_rate"),
        ratio(F.sum("trips"), F.sum("buyers")).alias("purchase_frequency"),
        ratio(F.sum("spend"), F.sum("trips")).alias("spend_per_trip"),
        ratio(F.sum("spend"), F.sum("quantity")).alias("asp"),
        ratio(F.sum("quantity"), F.sum("trips")).alias("units_per_trip"),
        ratio(F.sum(F.col("buyers") * F.col("age_adj")), F.max("active_users")).alias("panel_pen"),
        F.sum("buyers").alias("total_panelists"),
        F.sum("gmv").alias("gmv"),
    )
    kept = pooled.filter(F.col("total_panelists") > 0)
    if interval == CURRENT_YEAR:
        today = F.lit(as_of) if as_of is not None else last
        kept = kept.filter(month == floor_to("year", today))
    before = F.lag("panel_pen").over(Window.partitionBy(F.month("month")).orderBy("month"))
    return kept.withColumns(
        {
            "pen_change": ratio(F.col("panel_pen"), before) - 1,
            "total_shoppers": ratio(F.col("gmv"), F.col("buy_rate")),
        }
    )
