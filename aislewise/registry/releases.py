"""Marts and tables kept up to date by releases, and users counted over time."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from aislewise.operators import activity, publish
from aislewise.plans.incremental import IncrementalMart
from aislewise.plans.market_share import ITEM_COLUMNS
from aislewise.registry import checks, share, sql
from aislewise.registry.common import START_DATE, at
from aislewise.sources import inputs, sinks
from aislewise.sources.items import filter_items


def _released(t):
    """The item base with its release of three: most rows to 2000, late rows with a winter's months, and the rest."""
    items = filter_items(t, [*ITEM_COLUMNS, "user_id"], START_DATE)
    early, late = F.col("order_date") < "2001-01-01", F.col("user_id") % 10 == 3
    winter = (F.col("order_date") < "2001-04-01") & ~(F.col("user_id") % 7 == 0)
    first, second = early & ~late, (late & early) | (~early & winter)
    return items.withColumn("release", F.when(first, 1).when(~first & second, 2).when(~first & ~second, 3))


def _incremental(calendar):
    def query(spark, sf_dir):
        mart = IncrementalMart(spark, sinks.warehouse_folder(spark, "mart"), "major_cat", START_DATE, calendar)
        mart.add_all(_released(at(spark, sf_dir)), 3)
        return share.mart_report(mart.read())

    return query


def changes_applied(spark, sf_dir):
    """The former release with two change sets applied: one back to half of its keys, one on to the current release."""
    old, new = inputs.releases(at(spark, sf_dir))
    keys, buckets, mark = ["o_orderkey"], 16, uuid.uuid4().hex
    half = old.where(F.col("o_orderkey") % 2 == 0)
    sets = ((old, half, dt.datetime(2024, 1, 1)), (half, new, dt.datetime(2024, 2, 1)))
    base, changes = f"batch_{mark}", f"changes_{mark}"
    sinks.write_table(old, "default", base, bucket_by=(buckets, keys))
    for before, after, stamp in sets:
        sinks.append_changes(publish.changes_table(before, after, keys, stamp), "default", changes, keys, buckets)
    return spark.table(sinks.compact_changes(spark, "default", base, changes, keys, buckets, f"{base}_compact"))


def rolling_active_users(spark, sf_dir):
    orders = at(spark, sf_dir)("orders")
    return activity.rolling_active(orders, "o_custkey", "o_orderdate", 24)


def buyers_by_view(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["month", "merchant_clean", "user_id", "order_id"])
    return activity.distinct_by_view(items, "month", {"buyers": "user_id", "trips": "order_id"}, ("merchant_clean",))


QUERIES = {
    "market_share_incremental": _incremental("standard"),
    "market_share_incremental_454": _incremental("454"),
    "changes_applied": changes_applied,
    "rolling_active_users": rolling_active_users,
    "buyers_by_view": buyers_by_view,
}

_PERIODS = {
    "month": "month",
    "quarter": "date_trunc('quarter', month)",
    "year": "date_trunc('year', month)",
    "year to date": "CASE WHEN month(month) <= (SELECT month(max(month)) FROM items) THEN date_trunc('year', month) END",
    "all": "DATE '0001-01-01'",
}

ORACLE = {
    "market_share_incremental": share.ORACLE["market_share_std"],
    "market_share_incremental_454": share.ORACLE["market_share_454"],
    "changes_applied": sql.with_(*checks.RELEASES) + "SELECT * FROM current_rows",
    "rolling_active_users": """WITH m AS (SELECT DISTINCT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
each AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS month FROM m),
active AS (SELECT DISTINCT month, u FROM each JOIN m ON m.m <= month AND m.m > month - INTERVAL 24 MONTH)
SELECT month, (SELECT count(*) FROM active a WHERE a.month = e.month) AS active_users,
  (SELECT count(*) FROM active a WHERE a.month = e.month AND NOT EXISTS (SELECT 1 FROM active b WHERE b.u = a.u AND b.month = e.month - INTERVAL 1 MONTH)) AS started,
  (SELECT count(*) FROM active a WHERE a.month = e.month - INTERVAL 1 MONTH AND NOT EXISTS (SELECT 1 FROM active b WHERE b.u = a.u AND b.month = e.month)) AS lapsed
FROM each e""",
    "buyers_by_view": sql.with_(sql.ITEMS)
    + "\nUNION ALL\n".join(
        f"""SELECT '{view}' AS view, CAST({period} AS DATE) AS period, merchant_clean, count(DISTINCT user_id) AS buyers, count(DISTINCT order_id) AS trips
FROM items WHERE {period} IS NOT NULL GROUP BY ALL"""
        for view, period in _PERIODS.items()
    ),
}
