"""Incremental marts, applied changes, rolling users and distinct counts."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from aislewise.operators import activity, publish
from aislewise.plans.incremental import IncrementalMart
from aislewise.plans.market_share import ITEM_COLUMNS, market_share
from aislewise.sources import sinks
from aislewise.sources.items import filter_items

START = "1995-03-15"


@pytest.mark.parametrize("calendar", ["standard", "454"])
def test_releases_give_the_rows_of_a_full_rebuild(spark, tables, calendar):
    items = filter_items(tables, [*ITEM_COLUMNS, "user_id"], START).where("merchant_clean IN ('ASIA', 'EUROPE')")
    part = F.col("user_id") % 5
    parts = [items.where((F.col("order_date") < "1999-06-01") & (part < 2)), items.where((F.col("order_date") < "1999-06-01") & (part == 2))]
    parts.append(items.where((F.col("order_date") >= "1999-06-01") & (part < 3)))
    parts += [items.limit(0), items.where(part >= 3)]
    mart = IncrementalMart(spark, sinks.warehouse_folder(spark, "mart"), "major_cat", START, calendar)
    for number, rows in enumerate(parts, 1):
        mart.add(rows, number)
    whole = market_share(items, "major_cat", START, calendar)
    got = mart.read()
    assert got.columns == whole.columns and got.count() == whole.count() > 1000
    assert got.exceptAll(whole).count() == 0
    # The same release once more changes nothing.
    mart.add(parts[-1], len(parts))
    assert mart.read().exceptAll(whole).count() == 0 and mart.read().count() == whole.count()


def test_a_release_rewrites_only_its_months(spark, tables):
    items = filter_items(tables, ITEM_COLUMNS, START).where("merchant_clean = 'ASIA'")
    mart = IncrementalMart(spark, sinks.warehouse_folder(spark, "mart"), "major_cat", START)
    mart.add(items.where("order_date < '2001-06-01'"), 1)
    files = lambda: {r.f for r in spark.read.parquet(f"{mart.folder}/mart").select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    known = items.where("order_date < '2001-06-01'").select("brand", "sub_brand", "minor_cat", "channel").distinct()
    mart.add(items.where("order_date >= '2001-06-01'").join(known, ["brand", "sub_brand", "minor_cat", "channel"], "left_semi"), 2)
    month = lambda f: f.split("date=")[1][:10]
    kept = before & files()
    assert len(kept) > 10 and max(map(month, kept)) < min(map(month, before - kept))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k long, part string, v string, w long")


def test_changes_applied_in_buckets(spark):
    releases = [
        [(1, "a", "x", 1), (2, "", "y", 2), (3, "a", None, 3), (4, "b", "z", None), (5, "c", "gone", 5)],
        [(1, "a", "x2", 1), (2, "", "y", 2), (4, "b", "z", 4), (6, "d", "new", 6)],
        [(1, "a", "x2", 1), (2, "", None, 2), (3, "a", "back", 3), (5, "c", "gone", 5), (6, "d", "newer", 6)],
    ]
    frames, keys, mark = [rows_of(spark, r) for r in releases], ["k", "part"], uuid.uuid4().hex
    sinks.write_table(frames[0], "default", f"b_{mark}", bucket_by=(4, keys))
    for n, (old, new) in enumerate(zip(frames, frames[1:])):
        sinks.append_changes(publish.changes_table(old, new, keys, dt.datetime(2024, 1 + n, 1)), "default", f"c_{mark}", keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    made = publish.changes_applied(spark.table(f"default.b_{mark}"), spark.table(f"default.c_{mark}"), keys)
    plan = made._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "Exchange" not in plan
    full = sinks.compact_changes(spark, "default", f"b_{mark}", f"c_{mark}", keys, 4, f"n_{mark}")
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, spark.table(full).collect()), key=order) == sorted(releases[2], key=order)
    assert publish.changes_applied(frames[0], spark.table(f"default.c_{mark}").limit(0), keys).exceptAll(frames[0]).count() == 0


@pytest.mark.parametrize("months", [1, 3, 24])
def test_rolling_users_match_brute_force(spark, months):
    events = [(u, dt.date(2020 + (u * 7 + k * k) % 4, 1 + (u + 5 * k) % 12, 1 + k)) for u in range(40) for k in range(u % 6)]
    events += [(1, None), (None, dt.date(2019, 1, 1)), *events[:9]]
    got = {r.month: (r.active_users, r.started, r.lapsed) for r in activity.rolling_active(spark.createDataFrame(events, "u long, d date"), "u", "d", months).collect()}
    at = lambda d: d.year * 12 + d.month - 1
    seen = {(u, at(d)) for u, d in events if u is not None and d is not None}
    active = lambda m: {u for u, t in seen if m - months < t <= m}
    span = range(min(t for _, t in seen), max(t for _, t in seen) + 1)
    assert got == {dt.date(m // 12, m % 12 + 1, 1): (len(active(m)), len(active(m) - active(m - 1)), len(active(m - 1) - active(m))) for m in span}
    assert activity.rolling_active(spark.createDataFrame([], "u long, d date"), "u", "d", months).count() == 0


def test_distinct_counts_of_large_and_negative_numbers(spark):
    rows = [(dt.date(2020, 1 + k % 5, 1), x, None if k % 3 else k) for k, x in enumerate([-1, -32768, -32769, 0, 1, 32767, 32768, 32769, 2**40, 2**40, 1, 1, 0, None])]
    rows.append((None, 5, 5))
    got = {(r.view, r.period): (r.a, r.b) for r in activity.distinct_by_view(spark.createDataFrame(rows, "m date, x long, y long"), "m", {"a": "x", "b": "y"}).collect()}
    dated = [r for r in rows if r[0]]
    assert got["all", dt.date(1, 1, 1)] == (len({x for _, x, _ in dated if x is not None}), len({y for *_, y in dated if y is not None}))
    for m in range(1, 6):
        day = dt.date(2020, m, 1)
        assert got["month", day] == (len({x for d, x, _ in dated if d == day and x is not None}), len({y for d, _, y in dated if d == day and y is not None}))
