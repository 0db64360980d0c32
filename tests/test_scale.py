"""Marts that shuffle their items once."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from aislewise.operators.range_join import binned, lookups, range_join
from aislewise.plans import leakage, sku


def exchanges(df, by=""):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return sum("Exchange hashpartitioning(" + by in line for line in plan.splitlines())


def test_leakage_deals_users_once_and_keeps_every_known_purchase(spark):
    day = dt.date(2024, 2, 1)
    rows = [
        # Two raw merchants under one name, a user from outside the panel, keys that are missing, a date that is missing.
        (1, "panel_a", 1, "m1", "M", "b", day, "x", "y", "z", Decimal("2.00"), Decimal("3.00")),
        (1, "panel_a", 1, "m2", "M", "b", day, "x", "y", "z", Decimal("1.00"), Decimal("1.00")),
        (2, "panel_a", 0, "m1", "M", "b", day, "x", "y", "z", Decimal("9.00"), Decimal("1.00")),
        (3, "panel_b", 0, "m1", None, None, None, "x", "y", "z", Decimal("4.00"), Decimal("1.00")),
        (4, "panel_b", 0, "m1", "M", "b", day, "x", "y", "z", Decimal("7.00"), Decimal("1.00")),
        (None, "panel_b", 0, "m1", "M", "b", day, "x", "y", "z", Decimal("8.00"), Decimal("1.00")),
        (1, "panel_a", 1, None, "M", "b", day, "x", "y", "z", Decimal("8.00"), Decimal("1.00")),
    ]
    items = spark.createDataFrame(
        rows, "user_id long, source string, panel_flag int, merchant string, merchant_clean string, brand string, order_date date, "
        "major_cat string, sub_cat string, minor_cat string, item_price decimal(18,2), item_quantity decimal(12,2)")
    first = dt.date(2023, 1, 1)
    since = [(1, "m1", "panel_a", first), (1, "m2", "panel_a", first), (3, "m1", "panel_b", None), (2, "m1", "panel_a", first), (None, "m1", "panel_b", first)]
    known = spark.createDataFrame(since, "user_id long, merchant string, source string, first_active_quarter date")
    quarter = dt.date(2024, 1, 1)
    sizes = spark.createDataFrame([("m1", quarter, 5), ("m2", quarter, 6)], "merchant string, quarter date, total_users long")
    users = leakage.leakage_users(items, known, sizes, sizes.withColumn("source", F.lit("panel_a")))
    got = {(r.user_id, r.merchant, r.quarter, r.first_active_quarter, r.item_subtotal, r.total_panelists, r.total_panelists_channel) for r in users.collect()}
    assert got == {(1, "M", quarter, first, Decimal("7.0000"), 6, 6), (3, None, None, None, Decimal("4.0000"), None, None)}
    # Items and first quarters by user, and nothing by merchant, whose few values would hold whole lots of items.
    assert exchanges(users) == exchanges(users, "user_id") == 2


def test_a_retailer_without_a_name_is_a_retailer(spark):
    kinds = ("user_id int, first_active_quarter int, source string, merchant string, brand string, quarter int, major_cat string, "
             "sub_cat string, minor_cat string, item_subtotal decimal(18,2), total_panelists int")
    rows = [(1, 1, "s", None, "b", 2, "x", "y", "z", Decimal("5.00"), 7), (1, 2, "s", "m", "b", 2, "x", "y", "z", Decimal("3.00"), 8),
            (2, 2, "s", "m", "b", 2, "x", "y", "z", Decimal("4.00"), 9)]
    report = leakage.leakage_retailer(spark.createDataFrame(rows, kinds))
    got = {(r.key_retailer, r.merchant, r.closer_spend, r.other_spend, r.total_panelists) for r in report.collect()}
    assert got == {(None, None, Decimal("5.0000"), Decimal("0.0000"), 7), (None, "m", Decimal("3.0000"), Decimal("4.0000"), 9)}
    # One shuffle of user rows; the others move sums per cell.
    assert exchanges(report, "user_id") == 1 and exchanges(report) == 4


def test_product_marts_deal_items_once(spark):
    months = [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    rows = [(m + dt.timedelta(days=i % 3), m, "ONLINE", "x", "y", "z", f"w{i % 2}", "M", "b", "s", None if i < 2 else f"p{i}", i % 2,
             Decimal("1.00"), Decimal("2.00"), Decimal("3.00")) for m in months for i in range(6)]
    items = spark.createDataFrame(
        rows, "order_date date, month date, channel string, major_cat string, sub_cat string, minor_cat string, web_description string, "
        "merchant_clean string, brand string, sub_brand string, parent_brand string, product_id int, item_price decimal(18,2), "
        "item_quantity decimal(12,2), gmv decimal(18,4)")
    series = sku.sku_time_series(items)
    got = {(r.product_id, r.period_month, r.parent_brand, r.observations, r.last_obs, r.total_spend) for r in series.collect()}
    assert got == {(p, m, f"p{p + 2}", 3, None if m == months[0] else 3, Decimal("6.0000")) for p in (0, 1) for m in months}
    assert exchanges(series) == 1
    assert exchanges(sku.sku_analysis(items)) == 1


def test_points_are_looked_up_on_the_levels_of_their_key_only(spark):
    # One interval per key, each of another level.
    intervals = spark.createDataFrame([(k, 0, 2**k) for k in range(20)], "k int, s long, e long")
    points = spark.createDataFrame([(k, p) for k in range(25) for p in (0, 2**k, 2**k + 1)], "k int, p long").withColumn("__at", F.col("p"))
    placed = binned(intervals, F.col("s"), F.col("e"), F.lit(0), F.lit(2**40))
    assert lookups(points, placed, ["k"]).count() == 60
    assert lookups(points, placed, []).count() == 75 * 20
    met = range_join(points.drop("__at"), intervals, "p", "s", "e", ["k"], "inner")
    assert sorted((r.k, r.p) for r in met.collect()) == sorted((k, p) for k in range(20) for p in (0, 2**k))


def scans(df, column):
    """Scans of a table that the physical plan runs; those behind a shuffle that is used again are not repeated in it."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return sum("FileScan parquet" in line and column in line for line in plan.splitlines())


def test_price_reports_scan_their_items_once(spark, tables, sf_dir):
    from aislewise.registry import reports

    # The priced items once; band reports also the quarters of the report.
    assert scans(reports.price_quantiles(spark, sf_dir), "l_extendedprice") == 1
    for query in (reports.band_export, reports.band_share_merchant):
        found = query(spark, sf_dir)
        assert scans(found, "l_extendedprice") == 1 and scans(found, "l_orderkey") == 2


def test_items_dealt_by_product_move_no_product_texts(spark, tables, sf_dir):
    from aislewise.registry import products, reports

    for query in (products.QUERIES["sku_annual"], products.QUERIES["sku_month"], reports.price_item_base):
        df = query(spark, sf_dir)
        assert exchanges(df, "l_partkey") == 1
        assert exchanges(df, "product_id") == exchanges(df, "sku") == exchanges(df, "channel") == exchanges(df, "quarter") == 0


def test_intervals_of_neighbouring_lengths_share_a_level(spark):
    intervals = spark.createDataFrame([(i, i + 2**k) for k in range(20) for i in range(3)], "s long, e long")
    placed = binned(intervals, F.col("s"), F.col("e"), F.lit(0), F.lit(2**40), 4)
    assert sorted(r[0] for r in placed.select("__level").distinct().collect()) == [4, 8, 12, 16, 20]
    points = spark.createDataFrame([(p,) for p in range(0, 2**20, 7919)] + [(5,), (5,)], "p long")
    met = range_join(points, intervals, "p", "s", "e", how="inner")
    assert sorted(map(tuple, met.collect())) == sorted(
        (p, s, e) for (p,) in points.collect() for s, e in intervals.collect() if s <= p <= e)
    # Pairs that are found are not shuffled again: both sides meet in the last shuffles.
    assert exchanges(met, "p") == 0


def test_rolling_medians_aggregate_items_by_hash(spark):
    from aislewise.plans.medians import rolling_medians

    rows = [(g, q, float(v)) for g in range(3) for q in range(2) for v in (1, 2, 2, 9)] + [(0, 0, -0.0), (0, 0, 0.0)]
    items = spark.createDataFrame(rows, "g int, q int, v double")
    found = rolling_medians(items, ["g"], "q", "v")
    got = {(r.g, r.q): (r.n_values, r.within) for r in found.collect()}
    assert got == {(g, q): (4 * (q + 1) + 2 * (g == 0), True) for g in range(3) for q in range(2)}
    # Rows are dealt once; nothing is expanded before it is summed.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(true, false))" not in plan and "__sketched" not in plan


def test_releases_are_read_in_one_scan(spark, tables, tmp_path):
    from aislewise.plans.incremental import IncrementalMart
    from aislewise.plans.market_share import ITEM_COLUMNS
    from aislewise.sources.items import filter_items

    items = filter_items(tables, ITEM_COLUMNS, "1995-01-01").where("merchant_clean = 'ASIA'")
    number = F.when(F.col("order_date") < "2000-01-01", 1).when(F.col("order_date") < "2001-03-01", 3)
    one, two = (IncrementalMart(spark, str(tmp_path / n), "major_cat", "1995-01-01") for n in ("one", "two"))
    one.add_all(items.withColumn("release", number), 3)
    for release in (1, 3):
        two.add(items.where(number == release), release)
    assert one.read().exceptAll(two.read()).count() == two.read().exceptAll(one.read()).count() == 0


def test_percentiles_count_their_values_once(spark):
    from aislewise.plans.pricing import exact_percentiles

    rows = spark.createDataFrame([(k, float(v)) for k in "ab" for v in range(9)], "k string, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = exact_percentiles(rows, ["k"], "v", {"middle": 0.5})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.k, r.middle) for r in found.collect()) == [("a", 4.0), ("b", 4.0)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    counted = [line for line in plan.splitlines() if "Exchange hashpartitioning(k#" in line and ", v#" in line]
    assert sum("ReusedExchange" not in line for line in counted) == 1
