"""Filters, quality checks, comparisons, releases, configuration and sinks."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from aislewise.functions import predicates
from aislewise.operators import compare, publish, quality, schema
from aislewise.operators.grouping import latest_per_key, with_group_totals
from aislewise.sources import sinks
from aislewise.sources.client_config import any_date, client_config, list_text, read_config_csv
from aislewise.sources.tables import Tables


@pytest.fixture()
def store(spark):
    name = f"store_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_empty_choice_keeps_null_and_a_choice_drops_it(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert predicates.page_filter(df, {"c": []}).count() == 3
    assert predicates.page_filter(df, {"c": ["a"]}).count() == 1


def test_condition_groups_ignore_case_and_spaces(spark):
    df = spark.createDataFrame([(" AMZN ", "Nike"), ("x", "adidas"), ("x", "M&M's"), ("x", "other")], "ticker string, brand string")
    groups = [{"conditions": [{"field_name": "ticker", "values": ["AMZN"], "condition_operator": "NOT IN"},
                              {"field_name": "brand", "values": ["Nike", "Adidas", "M&M's"]}]}]
    assert {r.brand for r in df.filter(predicates.condition_groups(groups)).collect()} == {"adidas", "M&M's"}


def test_multiset_difference_agrees_with_except_all(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 2, "k int, v string")
    b = spark.createDataFrame([(1, None)] * 1 + [(3, "y")], "k int, v string")
    diff = {(r.k, r.v, r.side): r.surplus for r in compare.multiset_difference(a, b).collect()}
    assert diff == {(1, None, "only_first"): 2, (2, "x", "only_first"): 2, (3, "y", "only_second"): 1}
    assert compare.except_all(a, b).count() == 4
    assert compare.except_all(a, a).count() == 0
    same = compare.compare_tables(a, a).first()
    assert same.identical and same.rows_first == 5


def test_compare_sees_retyped_and_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    assert compare.column_differences(a, b) == [("v", "string", "missing"), ("w", "missing", "double")]
    assert not compare.compare_tables(a, b).first().schema_match
    stats = compare.compare_stats(a, b.withColumnRenamed("w", "v"), ["k"]).first()
    assert stats.stats_match


def test_swapped_nulls_are_not_duplicates(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string")
    row = quality.duplicate_check(df, []).first()
    assert (row.non_null_count, row.distinct_count, row.status) == (3, 2, "WARNING")


def test_group_totals_treat_null_as_a_group(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 4)], "g string, h string, n int")
    out = {(r.g, r.h): (r.by_g, r.by_h) for r in with_group_totals(df, "n", {"by_g": ["g"], "by_h": ["h"]}).collect()}
    assert out == {("a", "x"): (3, 5), ("a", "y"): (3, 2), (None, "x"): (4, 5)}


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, None)], "k int, ts int, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], "ts").collect()} == {(1, "new"), (2, None)}


def test_profile_and_live_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "k int, gone string, some string")
    assert {r.column: r.non_null_count for r in quality.nonnull_profile(df).collect()} == {"k": 2, "gone": 0, "some": 1}
    assert quality.live_columns(df, ["k"]).columns == ["some"]
    assert quality.nonnull_profile(df, fraction=0.5).count() == 3


def test_schema_versions(spark):
    old = spark.createDataFrame([], "state string, month date, gmv double").schema
    def kind(ddl):
        return schema.schema_change(old, spark.createDataFrame([], ddl).schema)[0]
    assert kind("state string, month date, gmv double") == "same"
    assert kind("state string, month date, gmv double, extra int") == "minor"
    assert kind("state string, gmv double, month date") == "minor"
    assert kind("state int, month date, gmv double") == "major"
    assert kind("state string, month date") == "major"
    assert schema.next_version("geo__v004_r0002", "major") == "geo__v005"
    assert schema.next_version("geo__v004", "minor") == "geo__v004"
    assert schema.next_version("geo", "same") == "geo__v000"
    assert schema.next_version("geo__v999_r0001", "major") == "geo__v1000"


def test_schema_report_accepts_sized_decimals(spark):
    df = spark.createDataFrame([], "order_date date, gmv decimal(18,4), merchant int, colour string")
    found = {(r.check, r.column): r.status for r in schema.schema_report(df).collect()}
    assert found["type", "gmv"] == "PASSED" and found["type", "merchant"] == "FAILED"
    assert found["mandatory", "brand"] == "FAILED" and found["undocumented", "colour"] == "WARNING"


def test_changes_between_releases(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "q")], "k int, v string, w string")
    out = {r.k: (r.record_status, r.v) for r in publish.changes_table(old, new, ["k"]).collect()}
    assert out == {2: ("UPDATE", "b"), 3: ("DELETE", "c"), 4: ("INSERT", "d")}


def test_point_in_time_reads(spark):
    first = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    second = spark.createDataFrame([(1, 11)], "k int, v int")
    history = publish.pit_rows(first, dt.datetime(2024, 1, 1)).unionByName(publish.pit_rows(second, dt.datetime(2024, 2, 1)))
    def at(day):
        return {r.k: r.v for r in publish.pit_as_of(history, ["k"], day).collect()}
    assert at(dt.datetime(2024, 1, 5)) == {1: 10, 2: 20}
    assert at(dt.datetime(2024, 3, 5)) == {1: 11, 2: 20}
    assert {r.k for r in publish.release_as_of(history, dt.datetime(2024, 3, 5)).collect()} == {1}
    assert {r.version for r in publish.numbered_versions(history, ["k"]).filter("k = 1").collect()} == {1, 2}


def test_config_texts(spark):
    df = spark.createDataFrame([("['A', 'B, C']",), ("Plain",), (None,), ("[\"x\"]",), ("[1, 2]",)], "t string")
    assert [r[0] for r in df.select(list_text(F.col("t"))).collect()] == [["A", "B, C"], ["Plain"], [], ["x"], ["1", "2"]]
    dates = spark.createDataFrame([("2024-02-29",), ("2/29/2024",), ("soon",)], "t string")
    assert [r[0] for r in dates.select(any_date(F.col("t"))).collect()] == [dt.date(2024, 2, 29)] * 2 + [None]


def test_newest_config_row_wins(spark, tmp_path):
    path = str(tmp_path / "form.csv")
    with open(path, "w") as f:
        f.write('Timestamp,"demo_name (lower case)",prod_schema,brands_display,start_date_of_data,packages\n')
        f.write('2/3/2024 9:05:00,shop,clients,"[\'Old\']",1/1/2020,\n')
        f.write('12/3/2024 9:05:00,shop,prospects,"[\'New\', \'Too\']",2021-01-01,"Market Share, Pro"\n')
    form = read_config_csv(spark, path, {"demo_name (lower case)": "demo_name", "Timestamp": "timestamp"})
    row = client_config(form, "prospects").first()
    assert row.brands_display == ["New", "Too"] and row.start_date_of_data == dt.date(2021, 1, 1)
    assert row.is_prospect and row.market_share and row.pro_module and not row.shopper_insights


def test_repair_copy_and_provenance(spark, store):
    df = spark.range(3).withColumns({"gone": F.lit(None), "attrs": F.lit(None)})
    full = sinks.write_table(sinks.stamped(df), store, "base", variant_columns=["attrs"])
    kinds = dict(spark.table(full).dtypes)
    assert kinds["gone"] == "string" and kinds["attrs"] == "variant" and kinds["_updated_timestamp"] == "timestamp"
    assert sinks.copy_table(spark, full, store, "copied") == {"source_rows": 3, "target_rows": 3, "match": True}
    sinks.set_provenance(spark, full, "3.8", "it's")
    assert sinks.provenance(spark, full) == {"version": "3.8", "commit": "it's"}
    rows = {r["property"]: r for r in sinks.provenance_differences(spark, [full, f"{store}.copied"]).collect()}
    assert rows["commit"].tables_without == [f"{store}.copied"] and rows["version"]["values"] == ["3.8"]
    assert sinks.provenance_differences(spark, [full, full]).count() == 0
    with pytest.raises(Exception):
        sinks.write_table(df, store, "base", overwrite=False)


def test_versions_and_views(spark, store):
    df = spark.range(2).withColumn("v", F.lit("a"))
    assert sinks.publish_version(df, store, "mart").endswith("mart__v000_r0000")
    # A release may read the view it replaces.
    wider = spark.table(f"{store}.mart").withColumn("extra", F.lit(1))
    assert sinks.publish_version(wider, store, "mart").endswith("__v000_r0001")
    assert spark.table(f"{store}.mart__v000_r0000").columns == ["id", "v"]
    assert sinks.publish_version(df.select("id"), store, "mart").endswith("__v001_r0000")
    assert spark.table(f"{store}.mart").columns == ["id"]
    sinks.publish_temp_view(df, "shown_rows")
    sinks.create_as_select(spark, f"{store}.chosen", "SELECT id FROM shown_rows")
    assert Tables(spark, schema=store)("chosen").count() == 2
    sinks.append_release(publish.pit_rows(df, dt.datetime(2024, 1, 1)), store, "history")
    sinks.append_release(publish.pit_rows(df, dt.datetime(2024, 2, 1)), store, "history")
    assert spark.table(f"{store}.history").count() == 4


def test_bucketed_tables_join_without_a_shuffle(spark, store):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    for name in ("left_side", "right_side"):
        sinks.write_table(df, store, name, bucket_by=(4, ["id"]))
    joined = spark.table(f"{store}.left_side").hint("merge").join(spark.table(f"{store}.right_side"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_bulk_attribute_fix_reports_before_it_writes(spark, store):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "k string, finish string")
    sinks.write_table(rows, store, "one_filter_items")
    sinks.write_table(rows.select("k"), store, "two_filter_items")
    sinks.write_table(rows, store, "other")
    dry = {r.table_name.split(".")[1]: (r.status, r.null_count) for r in sinks.standardize_tables(spark, [store], "*_filter_items", ["finish"]).collect()}
    assert dry == {"one_filter_items": ("WOULD_UPDATE", 1), "two_filter_items": ("NO_COLUMNS", None)}
    sinks.standardize_tables(spark, [store], "*_filter_items", ["finish"], dry_run=False)
    fixed = spark.table(f"{store}.one_filter_items_standardized")
    assert fixed.filter("finish = 'N/A'").count() == 1
