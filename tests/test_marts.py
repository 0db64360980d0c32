"""Invariants of the marts and their behaviour under skew."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aislewise.functions import labels
from aislewise.plans import brands, display, leakage, market_share, pricing, regions, shopper, sku
from aislewise.plans.monitor import run_attempts, run_status
from aislewise.registry.common import START_DATE
from aislewise.sources import inputs
from aislewise.sources.calendars import (
    fiscal_quarter_of,
    fiscal_quarters,
    retail_days,
    retail_month_columns,
    retail_month_of,
    retail_months,
)
from aislewise.sources.items import filter_items, prep_filter_items, source_items, with_optional


@pytest.fixture(scope="module")
def dense(tables):
    items = filter_items(tables, market_share.ITEM_COLUMNS, START_DATE)
    return market_share.market_share_dense(items, "major_cat", START_DATE).persist()


def test_items_keep_every_line_whatever_columns_are_asked_for(tables):
    lines = tables("lineitem").count()
    assert filter_items(tables).count() == lines
    assert filter_items(tables, ["gmv"]).count() == lines


def test_unused_dimensions_are_not_joined(tables):
    plan = filter_items(tables, ["gmv", "order_date"])._jdf.queryExecution().optimizedPlan().toString()
    assert "orders" in plan or "o_orderdate" in plan
    assert "s_suppkey" not in plan and "p_partkey" not in plan and "c_custkey" not in plan


def test_start_date_cuts_items_and_special_attributes_become_text(tables):
    source = source_items(tables, ["order_date", "type_name", "noun", "panel_flag", "sku"])
    base = prep_filter_items(source, ["type_name", "noun"], dt.date(1999, 1, 1), ["panel_flag"], "sku")
    assert base.agg(F.min("order_date")).first()[0] >= dt.date(1999, 1, 1)
    assert dict(base.dtypes)["panel_flag"] == "string"
    assert base.filter(F.col("sub_cat") != F.col("minor_cat")).count() == 0


def test_missing_optional_columns_are_typed_nulls(tables):
    df = with_optional(filter_items(tables, ["brand"]), ["gender", "panel_end_date", "brand"])
    assert dict(df.dtypes) == {"brand": "string", "gender": "string", "panel_end_date": "date"}


def test_retail_calendar_follows_the_published_years(spark):
    starts = {r.retail_year: (r.retail_year_start, r.retail_year_end) for r in retail_months(spark, 2017, 2026).collect()}
    assert starts[2017] == (dt.date(2017, 1, 29), dt.date(2018, 2, 3))
    assert starts[2023] == (dt.date(2023, 1, 29), dt.date(2024, 2, 3))
    assert starts[2025] == (dt.date(2025, 2, 2), dt.date(2026, 1, 31))
    september = retail_months(spark, 2025, 2025).filter("retail_month_for_trailing = date'2025-09-01'").first()
    assert september.retail_month_start == dt.date(2025, 8, 31)


def test_retail_calendar_covers_every_day_once(spark):
    days = retail_days(spark, 2000, 2020)
    n = days.count()
    first, last = days.agg(F.min("cal_day"), F.max("cal_day")).first()
    assert n == days.select("cal_day").distinct().count() == (last - first).days + 1


def test_fiscal_quarters_do_not_overlap(spark):
    rows = fiscal_quarters(spark, 2000, 2005).orderBy("start_date").collect()
    assert all(b.start_date == a.end_date + dt.timedelta(days=1) for a, b in zip(rows, rows[1:]))


def test_attribute_list_is_not_changed_and_has_no_repeats():
    chosen = ["finish", "major_cat", "finish"]
    assert market_share.attribute_columns(chosen) == ["finish", "major_cat"]
    assert chosen == ["finish", "major_cat", "finish"]


def test_mart_tables_carry_both_calendars_and_a_stamp(tables):
    items = filter_items(tables, [*market_share.ITEM_COLUMNS, "finish"])
    out = market_share.market_share_tables(items, ["finish"], START_DATE)
    assert len(out) == 6
    assert "_updated_timestamp" in out["market_share_for_column_null_454_calendar"].columns
    filled = out["market_share_for_column_finish_standard_calendar"]
    assert dict(filled.dtypes)["gmv_trailing_12m"] == "decimal(36,8)"
    assert {r[0] for r in filled.select("special_attribute").distinct().collect()} > {"S", "M", "L"}


def test_dense_mart_keeps_the_total(tables, dense):
    total = filter_items(tables, ["gmv"]).agg(F.sum("gmv")).first()[0]
    assert dense.agg(F.sum("gmv")).first()[0] == total


@pytest.mark.parametrize("interval", ["Annually", "Quarterly", "Weekly", "Trailing 3 Months", "Trailing 6 Months", "Year-to-Date"])
def test_shares_of_a_period_sum_to_one(dense, interval):
    shown = display.share_display(dense, display.ShareView(interval=interval, level="sub", top=3, min_sample=1))
    sums = shown.groupBy("display_time").agg(F.sum("gmv_perc").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-9 for r in sums if r.s is not None)


def test_pooled_categories_when_the_sample_is_thin(dense):
    shown = display.share_display(dense, display.ShareView(level="sub", min_sample=10**9))
    assert {r[0] for r in shown.select("display_cat").distinct().collect()} == {labels.OTHER_CATEGORIES}
    assert display.risk_message(shown).first()[0] == display.RISK_TEXT


def test_ytd_month_after_the_newest_belongs_to_the_year_before(spark):
    mart = spark.createDataFrame([(dt.date(2025, 8, 1),)], "trunc_day date")
    def anchor(m):
        return mart.select(display.ytd_anchor(mart, m)[0]).first()[0]
    assert anchor(None) == dt.date(2025, 8, 1)
    assert anchor(3) == dt.date(2025, 3, 1)
    assert anchor(10) == dt.date(2024, 10, 1)


def test_date_window_of_a_display(dense):
    view = display.ShareView(level="sub", start=dt.date(1999, 1, 1), end=dt.date(1999, 3, 1), min_sample=0)
    months = {r[0] for r in display.share_display(dense, view).select("display_time").collect()}
    assert months == {dt.date(1999, 1, 1), dt.date(1999, 2, 1)}


def test_scorecard_growth_needs_a_large_sample(spark):
    row = ("m", "b", "d", 1, "a", "s", "n", Decimal(200), 600, Decimal(100), Decimal(50), Decimal(10), 2000, None)
    schema = ("merchant string, brand string, web_description string, product_id int, major_cat string, sub_cat string, "
              "minor_cat string, gmv decimal(18,2), last_obs int, last_gmv decimal(18,2), total_spend decimal(18,2), "
              "total_units decimal(18,2), observations int, product_hash string")
    small = (*row[:12], 300, None)
    big, little = (sku.sku_scorecard(spark.createDataFrame([r], schema)).first() for r in (row, small))
    assert (big.ssr, big.yoy_growth, big.units) == ("Low Risk", 1.0, 40.0)
    assert (little.ssr, little.yoy_growth) == ("Some Risk", None)


def test_product_found_by_its_hash(tables):
    items = filter_items(tables, ["web_description", "brand", "merchant", "sku"])
    one = items.filter("web_description is not null").orderBy("sku", "merchant").first()
    digest = items.sparkSession.range(1).select(
        sku.product_hash(F.lit(one.web_description), F.lit(one.brand), F.lit(one.merchant), F.lit(one.sku))
    ).first()[0]
    found = sku.find_product(items, digest).collect()
    assert found and {r.sku for r in found} == {one.sku}


def test_brand_chart_shares_and_pooling(spark):
    rows = [(f"20{20 + i // 4} {i % 4 + 1}Q", "D", "C", "S", "Online", "M", f"B{j}", Decimal(100 - j)) for i in range(20) for j in range(18)]
    view = spark.createDataFrame(
        rows, "quarter string, department string, class string, sub_class string, channel string, merchant string, "
        "clean_brand string, rolling_merchant_gmv decimal(18,2)")
    chart = brands.brand_chart(view).collect()
    assert len({r.quarter for r in chart}) == 17
    assert {r.brand_name for r in chart} == {f"B{j}" for j in range(15)} | {"Other Brands"}
    per_quarter = defaultdict(float)
    for r in chart:
        per_quarter[r.quarter] += r.brand_share
    assert all(abs(v - 1) < 1e-9 for v in per_quarter.values())


def test_focus_retailer_is_always_shown(spark):
    rows = [("2024 1Q", f"R{j}", "Online", "D", "C", "S", Decimal(1000 - j)) for j in range(30)] + [("2024 1Q", "tiny", "Online", "D", "C", "S", Decimal(1))]
    base = spark.createDataFrame(rows, "quarter string, merchant string, channel string, department string, class string, sub_class string, gmv decimal(18,2)")
    names = {r.retailer_name for r in brands.competitor_share(base, "tiny").collect()}
    assert "tiny" in names and len(names) == 16


def test_ties_at_the_last_rank_are_kept(spark):
    from aislewise.operators.grouping import top_ranked

    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "k string, v int")
    assert {r.k for r in top_ranked(df, "k", F.sum("v"), 2).collect()} == {"a", "b", "c"}


def test_band_labels_and_table(spark):
    table = pricing.price_band_table(spark, 0, 50).collect()
    assert [r.descr for r in table] == ["A. (0 - 50)", "B. (50 - 100)", "C. (100 - 150)", "D. (150 - 200)", "E. (200 +)"]
    prices = spark.createDataFrame([(0,), (49,), (50,), (199,), (200,), (9999,)], "p int")
    bands = [r[0][0] for r in prices.select(labels.price_band(F.col("p"), 0, 50)).collect()]
    assert bands == ["A", "A", "B", "D", "E", "E"]


def test_band_share_is_hidden_without_a_step(tables):
    charts = pricing.charts_base(inputs.priced_items(tables), inputs.retailer_mapping(tables))
    quarters = charts.select("quarter").distinct()
    assert pricing.band_share(charts, quarters, 0, 0, min_sample=0).count() == 0
    shown = pricing.band_share(charts, quarters, 0, 1000, min_sample=0, min_avg=0, min_median=0)
    sums = shown.groupBy("quarter").agg(F.sum("market_share").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-9 for r in sums)


def brute_leakage(rows):
    first, spent, closer = {}, defaultdict(int), defaultdict(int)
    for user, merchant, since, quarter, spend in rows:
        first[merchant, user] = min(first.get((merchant, user), since), since)
        spent[merchant, quarter] += spend
    for retailer in {r[1] for r in rows}:
        for user, merchant, _, quarter, spend in rows:
            if first.get((retailer, user), quarter) < quarter:
                closer[retailer, merchant, quarter] += spend
    return {(k, m, q): (c, spent[m, q] - c) for (k, m, q), c in closer.items()}


def leakage_frame(spark, rows):
    full = [(u, f, "s", m, "b", q, "x", "y", "z", Decimal(v), 7) for u, m, f, q, v in rows]
    return spark.createDataFrame(
        full, "user_id int, first_active_quarter int, source string, merchant string, brand string, quarter int, major_cat string, "
        "sub_cat string, minor_cat string, item_subtotal decimal(18,2), total_panelists int")


def test_leakage_with_one_user_holding_a_third_of_the_rows(spark):
    rows = [(0, f"m{i % 4}", i % 3, i % 5, 10 + i) for i in range(60)]
    rows += [(1 + i % 40, f"m{i % 4}", i % 3, (i * 7) % 5, i) for i in range(120)]
    result = leakage.leakage_retailer(leakage_frame(spark, rows)).collect()
    got = {(r.key_retailer, r.merchant, r.quarter): (int(r.closer_spend), int(r.other_spend)) for r in result}
    assert got == brute_leakage(rows) and got


def test_closer_and_non_closer_add_up_to_the_total_for_every_retailer(tables):
    columns = ["user_id", "source", "panel_flag", "merchant", "merchant_clean", "brand", "order_date", "major_cat", "sub_cat",
               "minor_cat", "item_price", "item_quantity"]
    users = leakage.leakage_users(
        filter_items(tables, columns), inputs.retail_users(tables), inputs.panelists(tables, False), inputs.panelists(tables, True)
    ).persist()
    cells = leakage.leakage_cells(users)
    assert cells.agg(F.sum("spend")).first()[0] == users.agg(F.sum("item_subtotal")).first()[0]
    both = leakage.leakage_retailer(users).join(cells.withColumnRenamed("total_panelists", "size"), list(leakage.CELL))
    assert both.count() > 0 and both.where("closer_spend + other_spend <> spend or closer_spend < 0 or other_spend < 0").count() == 0


def test_panel_flag_of_every_membership(spark):
    day = dt.date(2024, 1, 1)
    items = spark.createDataFrame([(1, 1, day, "65+"), (2, 1, day, "18-24"), (3, 0, day, None), (4, 0, day, "45-54")],
                                  "user_id int, panel_flag int, year date, age string")
    annual = spark.createDataFrame([(1, day), (3, day)], "user_id int, year date")
    weights = spark.createDataFrame([("2024", "boomer_plus", 1.5)], "year string, age_cohort string, hh_size_adj_factor double")
    out = {r.user_id: r for r in shopper.shopper_enriched(items, annual.select("user_id"), annual, weights, weights).collect()}
    assert {u: r.panel_flag_test for u, r in out.items()} == {1: 1, 2: 2, 3: 3, 4: None}
    assert out[1].age_adj_2yr == 1.5 and out[2].age_adj_annual is None and out[4].annual_active_users == 2


def test_projected_month_is_appended(spark):
    mart = spark.createDataFrame([(dt.date(2025, 9, 1), Decimal("100.00")), (dt.date(2025, 8, 1), Decimal("7.00"))], "month date, gmv decimal(18,2)")
    out = regions.with_projected_month(mart, dt.date(2025, 9, 1), dt.date(2025, 10, 1))
    assert {(r.month, r.gmv) for r in out.collect()} >= {(dt.date(2025, 10, 1), Decimal("115.00"))}
    assert out.count() == 3


def test_attempts_of_a_busy_client_are_all_there(spark):
    stamp = dt.datetime(2024, 1, 3)
    rows = [(i, "nightly", '["busy"]', stamp + dt.timedelta(minutes=i), 1, None) for i in range(5000)]
    rows += [(9000, "nightly", '["calm"]', stamp, 2, "x" * 300), (9001, "other_job", '["calm"]', stamp, 2, None)]
    log = spark.createDataFrame(rows, "run_id int, name string, args string, end_timestamp timestamp, user int, error string")
    clients = spark.createDataFrame([("busy", "Monthly"), ("calm", "Monthly"), ("idle", "Quarterly")], "demo_name string, frequency string")
    out = {r.args: r for r in run_status(log, clients, "nightly", dt.date(2024, 1, 9)).collect()}
    assert out["busy"].runs_count == 5000 and out["busy"].status == "success"
    assert (out["busy"].first_attempt, out["busy"].last_attempt) == (stamp, stamp + dt.timedelta(minutes=4999))
    assert out["calm"].status == "needs_fix" and len(out["calm"].error) == 203 and out["calm"].runs_count == 1
    assert out["idle"].status == "needs_run" and out["idle"].first_attempt is None
    assert run_attempts(log, "nightly", dt.date(2024, 1, 9)).filter("args = 'busy'").count() == 5000


def test_calendars_have_no_first_or_last_year(spark):
    days = spark.createDataFrame([(dt.date(y, m, d),) for y in (1985, 2019, 2040) for m in range(1, 13) for d in (1, 15, 28)], "cal_day date")
    by_rule = days.withColumn("retail_month_for_trailing", retail_month_of(F.col("cal_day")))
    by_rule = by_rule.withColumns(retail_month_columns(F.col("retail_month_for_trailing")))
    listed = retail_days(spark, 1984, 2041)
    assert by_rule.exceptAll(listed.select(*by_rule.columns).join(days, "cal_day", "left_semi").select(*by_rule.columns)).count() == 0
    year, quarter = fiscal_quarter_of(F.col("cal_day"))
    ruled = days.withColumns({"y": year, "q": quarter})
    quarters = fiscal_quarters(spark, 1984, 2041)
    joined = days.join(quarters, F.col("cal_day").between(F.col("start_date"), F.col("end_date")))
    assert ruled.exceptAll(joined.select("cal_day", F.col("year").cast("string").alias("y"), F.col("qtr").alias("q"))).count() == 0
