"""Leakage marts: what a retailer's shoppers spend elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.periods import floor_to

CELL = ("source", "merchant", "brand", "quarter", "major_cat", "sub_cat", "minor_cat")
# Lots that users are dealt to. A lot is worked on by one task, so many lots keep its memory small.
USER_PARTS = 256


def leakage_users(
    items: DataFrame,
    retail_users: DataFrame,
    total_panelists: DataFrame,
    channel_panelists: DataFrame,
    open_source: str = "panel_b",
    flagged_source: str = "panel_a",
) -> DataFrame:
    """Spend per user, merchant, quarter and category of users known to the retailer panel.

    Rows of ``flagged_source`` count only with the panel flag set. Panel sizes are per raw merchant; where
    several raw merchants share a clean name the largest size is reported.
    """
    in_panel = (F.col("source") == open_source) | ((F.col("source") == flagged_source) & (F.col("panel_flag") == 1))
    dated = items.filter(in_panel).dropna(subset=["user_id", "merchant", "source"]).withColumn("quarter", floor_to("quarter", F.col("order_date")))
    # Every later step keeps a user's rows together, so items are shuffled once, by user. Hardly two items of a user are
    # alike: sums before the shuffle would not shrink it.
    known = dated.select(
        "user_id", "source", "merchant", "merchant_clean", "brand", "quarter", "major_cat", "sub_cat", "minor_cat",
        (F.col("item_price") * F.col("item_quantity")).alias("item_subtotal"),
    ).repartition(USER_PARTS, "user_id")
    # One row per user, with the merchants as a map: joined on the user alone, neither side moves again.
    at = F.struct("merchant", "source")
    since = retail_users.dropna(subset=["user_id", "merchant", "source"]).repartition(USER_PARTS, "user_id")
    since = since.groupBy("user_id", "merchant", "source").agg(F.min("first_active_quarter").alias("__first"))
    since = since.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(at, F.col("__first")))).alias("__since"))
    known = known.join(since, "user_id").filter(F.map_contains_key("__since", at))
    known = known.withColumn("first_active_quarter", F.element_at("__since", at)).drop("__since")
    # Panel sizes depend on merchant, quarter and source only: few rows, however many users there are.
    known = known.join(
        F.broadcast(total_panelists.withColumnRenamed("total_users", "total_panelists")), ["merchant", "quarter"], "left"
    )
    known = known.join(
        F.broadcast(channel_panelists.withColumnRenamed("total_users", "total_panelists_channel")),
        ["merchant", "quarter", "source"],
        "left",
    )
    return (
        known.drop("merchant")
        .withColumnRenamed("merchant_clean", "merchant")
        .groupBy("user_id", "first_active_quarter", *CELL)
        .agg(
            F.sum("item_subtotal").alias("item_subtotal"),
            F.max("total_panelists").alias("total_panelists"),
            F.max("total_panelists_channel").alias("total_panelists_channel"),
        )
    )


def leakage_cells(users: DataFrame) -> DataFrame:
    """One row per cell of the market: its whole spend, whoever the spender is."""
    return users.groupBy(*CELL).agg(F.sum("item_subtotal").alias("spend"), F.max("total_panelists").alias("total_panelists"))


def leakage_retailer(users: DataFrame) -> DataFrame:
    """For every retailer the cells in which its closers spend, with their spend and that of everyone else.

    A user is a closer of a retailer in the quarters after the first one active there. A row of a user carries the
    list of retailers known by then, and rows are summed per cell and list before the lists are opened. A cell meets
    only the retailers that have closers in it: where a retailer has no row for a cell, all of :func:`leakage_cells` is
    spend of others. The full product of cells and retailers is never built.
    """
    at_retailer = Window.partitionBy("user_id", "merchant")
    visited = F.struct(F.col("merchant").alias("retailer"), F.min("first_active_quarter").over(at_retailer).alias("since"))
    # Users dealt alike before are not dealt again.
    listed = users.repartition(USER_PARTS, "user_id").withColumn("__visited", visited)
    listed = listed.withColumn("__visited", F.collect_set("__visited").over(Window.partitionBy("user_id")))
    before = F.filter("__visited", lambda v: v["since"] < F.col("quarter"))
    known = F.array_sort(F.transform(before, lambda v: F.struct(F.lit(False).alias("whole"), v["retailer"].alias("key_retailer"))))
    summed = listed.groupBy(*CELL, known.alias("__known")).agg(
        F.sum("item_subtotal").alias("spend"), F.max("total_panelists").alias("total_panelists")
    )
    # The whole cell is one more entry of every list, told apart from a retailer without a name.
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast(users.schema["merchant"].dataType).alias("key_retailer")))
    by_key = summed.withColumn("__key", F.explode(F.concat(whole, "__known"))).groupBy(*CELL, "__key").agg(
        F.sum("spend").alias("closer_spend"), F.max("total_panelists").alias("total_panelists")
    )
    # A cell has at most one row per retailer.
    in_cell = Window.partitionBy(*CELL)
    is_whole = F.col("__key.whole")
    totals = by_key.withColumns(
        {
            "spend": F.max(F.when(is_whole, F.col("closer_spend"))).over(in_cell),
            "total_panelists": F.max(F.when(is_whole, F.col("total_panelists"))).over(in_cell),
        }
    )
    return totals.filter(~is_whole).select(
        F.col("__key.key_retailer").alias("key_retailer"),
        *CELL,
        F.col("closer_spend").cast("decimal(38,4)").alias("closer_spend"),
        (F.col("spend") - F.col("closer_spend")).cast("decimal(38,4)").alias("other_spend"),
        "total_panelists",
    )
