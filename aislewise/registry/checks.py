"""Quality checks, comparisons, releases, run monitor and client configuration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aislewise.functions import labels
from aislewise.operators import compare, publish, quality, schema
from aislewise.operators.grouping import latest_per_key
from aislewise.plans import monitor
from aislewise.plans.pricing import exact_percentiles
from aislewise.registry import sql
from aislewise.registry.common import at, tidy
from aislewise.sources import inputs
from aislewise.sources.calendars import retail_month_columns, retail_month_of
from aislewise.sources.client_config import client_config, read_config_csv
from aislewise.sources.items import filter_items
from aislewise.sources.sinks import copy_files, warehouse_folder

DQ_COLUMNS = ["order_date", "brand", "parent_brand", "merchant", "item_price", "item_quantity", "gmv", "user_id", "order_id",
              "product_id", "web_description", "finish"]
EARLIEST, LATEST = dt.date(1995, 6, 1), dt.date(2001, 6, 30)


def _dq(t):
    return filter_items(t, DQ_COLUMNS)


def dq_nulls(spark, sf_dir):
    return quality.null_check(_dq(at(spark, sf_dir)), [*quality.CRITICAL, "web_description", "parent_brand"])


def dq_negative(spark, sf_dir):
    adjusted = _dq(at(spark, sf_dir)).withColumn("full_price_estimate", F.col("gmv") - F.col("item_price"))
    return quality.negative_check(adjusted)


def dq_dates(spark, sf_dir):
    return quality.date_check(_dq(at(spark, sf_dir)), earliest=EARLIEST, latest=LATEST)


def _gappy_texts(t):
    """Item texts with blanks where an attribute is missing."""
    return _dq(t).withColumns(
        {
            "brand": F.coalesce("parent_brand", F.lit("")),
            "merchant": F.when(F.col("web_description").isNotNull(), F.col("merchant")).otherwise("  "),
        }
    )


def dq_blank(spark, sf_dir):
    return quality.blank_check(_gappy_texts(at(spark, sf_dir)))


def dq_duplicates(spark, sf_dir):
    rows = filter_items(at(spark, sf_dir), ["order_id", "user_id", "brand", "merchant_clean", "channel", "major_cat"])
    return quality.duplicate_check(rows)


def dq_date_formats(spark, sf_dir):
    day = F.col("order_date")
    texts = filter_items(at(spark, sf_dir), ["order_date", "channel", "finish"]).select(
        F.when(F.col("channel") == "ONLINE", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("finish") == "S", F.date_format(day, "MM/dd/yyyy"))
        .when(F.col("finish") == "M", F.date_format(day, "yyyy/MM/dd"))
        .when(F.col("finish") == "L", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(day, "d MMM"))
        .alias("order_text"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_text"),
    )
    return quality.date_format_check(texts, ["order_text", "iso_text"])


def nonnull_profile(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*DQ_COLUMNS, "age", "channel"]).withColumn("gender", F.lit(None).cast("string"))
    return quality.nonnull_profile(items, ["user_id"])


def live_columns(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["month", "brand", "finish", "gmv"]).withColumn("gender", F.lit(None).cast("string"))
    summed = items.groupBy("month", "brand", "finish", "gender").agg(F.sum("gmv").alias("gmv"))
    return tidy(quality.live_columns(summed))


def standardize_attributes(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["finish", "parent_brand", "major_cat", "gmv"])
    fixed = quality.standardize_attributes(items, ["finish", "parent_brand", "colour"])
    return tidy(
        fixed.groupBy("finish", "parent_brand", "major_cat").agg(F.count(F.lit(1)).alias("n_items"), F.sum("gmv").alias("gmv"))
    )


def validate_attributes(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["finish", "brand"])
    return quality.validate_attributes(items, ["finish", "brand", "colour"])


def _tagged_attributes(t):
    items = filter_items(t, ["merchant", "major_cat", "finish", "product_attributes"])
    leaked = F.when(F.col("finish").isNull(), F.concat(F.lit('{"major_cat":"'), "major_cat", F.lit('"}')))
    return items.select(
        F.col("merchant").alias("demo_name"), F.coalesce(leaked, F.to_json("product_attributes")).alias("attrs_json")
    )


def attr_fill_rate(spark, sf_dir):
    return quality.attribute_fill(_tagged_attributes(at(spark, sf_dir)), "demo_name", "attrs_json")


def attr_top_values(spark, sf_dir):
    return quality.top_values(_tagged_attributes(at(spark, sf_dir)), "attrs_json", 10)


def attr_status(spark, sf_dir):
    """Validity of the product attributes in tables with, without and with other kinds of them."""
    t = at(spark, sf_dir)
    items = filter_items(t, ["sku", "product_attributes"])
    frames = {
        "items": items,
        "items_as_text": items.withColumn("product_attributes", F.to_json("product_attributes")),
        "items_without": items.where(F.col("product_attributes").isNull()),
        "orders": t("orders"),
        "returns": None,
    }
    return quality.attribute_validity(frames, "product_attributes")


def freshness(spark, sf_dir):
    t = at(spark, sf_dir)
    tagged = filter_items(t, ["state", "order_date"]).withColumnRenamed("state", "table_name")
    expected = inputs.retailer_mapping(t).select(
        F.explode(F.array("merchant", F.concat("final_name", F.lit("_missing")))).alias("table_name"),
        F.lit(dt.date(2001, 8, 1)).alias("expected_date"),
    )
    return quality.freshness(tagged, expected.distinct())


def freshness_profile(spark, sf_dir):
    events = at(spark, sf_dir)("events")
    return quality.freshness_profile(events.select(F.col("event_type").alias("table_name"), F.col("ts").alias("_updated_timestamp")))


def schema_report(spark, sf_dir):
    items = filter_items(at(spark, sf_dir))
    report = schema.schema_report(items)
    return report.join(quality.nonnull_profile(items), "column", "left")


def _years(t):
    """Item totals of the two panels as two versions of one table; each has rows that the other lacks."""
    columns = ["year", "brand", "major_cat", "source", "gmv", "item_quantity"]
    by = filter_items(t, columns).groupBy("year", "brand", "major_cat", "source").agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum("item_quantity").alias("units")
    )
    return tuple(by.filter(F.col("source") == panel).drop("source") for panel in ("panel_a", "panel_b"))


def _lines(t):
    lines = t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_discount")
    return lines.filter(F.col("l_discount") < 0.08), lines.filter(F.col("l_discount") > 0.02)


def except_all(spark, sf_dir):
    """Line shapes that occur more often among little-discounted lines than among discounted ones, copies counted."""
    first, second = (d.drop("l_discount") for d in _lines(at(spark, sf_dir)))
    rows = compare.except_all(first, second)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def compare_tables(spark, sf_dir):
    return compare.compare_tables(*_years(at(spark, sf_dir)))


def multiset_difference(spark, sf_dir):
    return compare.multiset_difference(*(d.drop("l_discount") for d in _lines(at(spark, sf_dir))))


def numeric_stats(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["item_price", "item_quantity", "gmv", "panel_flag"])
    stats = compare.numeric_stats(items)
    return stats.withColumn("stddev", F.round("stddev", 4))


def compare_stats(spark, sf_dir):
    t = at(spark, sf_dir)
    items = filter_items(t, ["item_price", "item_quantity", "gmv", "channel"])
    stats = compare.compare_stats(items, items.filter(F.col("channel") == "ONLINE"), ["item_price", "item_quantity", "gmv"])
    return stats.withColumns({c: F.round(c, 4) for c in ("stddev", "stddev_second")})


def changes_table(spark, sf_dir):
    old, new = inputs.releases(at(spark, sf_dir))
    return publish.changes_table(old, new, ["o_orderkey"], dt.datetime(2024, 1, 1)).drop("record_status_timestamp")


def pit_append(spark, sf_dir):
    """Both releases appended to the history, read back as of a time between and after them."""
    old, new = inputs.releases(at(spark, sf_dir))
    first, second = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    stamp = "publication_timestamp"
    history = publish.pit_rows(old, first).unionByName(publish.pit_rows(new, second))
    between = publish.pit_as_of(history, ["o_orderkey"], dt.datetime(2024, 1, 15)).withColumn("as_of", F.lit("between"))
    after = publish.pit_as_of(history, ["o_orderkey"], dt.datetime(2024, 2, 15)).withColumn("as_of", F.lit("after"))
    both = between.unionByName(after).withColumn(stamp, F.col(stamp).cast("date"))
    return both


def schema_change(spark, sf_dir):
    """Change of layout between two marts of the same items, with the rows of each version."""
    t = at(spark, sf_dir)
    by = filter_items(t, ["state", "major_cat", "brand", "gmv"]).groupBy("state", "major_cat", "brand").agg(F.sum("gmv").alias("gmv"))
    changed = by.select("state", F.lit(1).alias("major_cat"), F.concat("major_cat", "brand").alias("super_brand"), "gmv")
    report = schema.schema_change_report(by, changed)
    return report.withColumn("rows_previous", by.agg(F.count(F.lit(1))).scalar())


def null_type_repair(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["brand", "gmv"]).groupBy("brand").agg(F.sum("gmv").alias("gmv"))
    untyped = items.withColumns({"gender": F.lit(None), "product_attributes": F.lit(None)})
    repaired = schema.repair_null_types(untyped, ["product_attributes"])
    return tidy(repaired.withColumn("product_attributes", F.to_json("product_attributes")))


def _content(orders):
    """Rows of the orders and a sum of hashes of their content."""
    texts = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    texts += [(F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")]
    hashed = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in texts]))
    return orders.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.conv(F.substring(hashed, 1, 10), 16, 10).cast("bigint")).alias("content"),
    )


def copy_check(spark, sf_dir):
    """Orders copied to shared storage; rows and content of both sides."""
    orders = at(spark, sf_dir)("orders")
    source, target = _content(orders), _content(copy_files(orders, "orders_copy"))
    found = source.withColumnsRenamed({"rows": "source_rows", "content": "source_content"}).withColumns(
        {"target_rows": target.select("rows").scalar(), "target_content": target.select("content").scalar()}
    )
    same = (F.col("source_rows") == F.col("target_rows")) & F.col("source_content").eqNullSafe(F.col("target_content"))
    return found.withColumn("match", same)


MONTH = dt.date(2024, 1, 15)


def run_status(spark, sf_dir):
    t = at(spark, sf_dir)
    return monitor.run_status(inputs.run_log(t), inputs.log_clients(t), inputs.JOB, MONTH)


def run_attempts(spark, sf_dir):
    return monitor.run_attempts(inputs.run_log(at(spark, sf_dir)), inputs.JOB, MONTH)


def latest_runs(spark, sf_dir):
    return monitor.latest_runs(inputs.run_log(at(spark, sf_dir)), inputs.JOB, dt.datetime(2024, 1, 10))


def runs_per_hour(spark, sf_dir):
    return monitor.runs_per_hour(inputs.run_log(at(spark, sf_dir)), dt.datetime(2024, 1, 2))


def not_refreshed(spark, sf_dir):
    """Customers without an order in the last year of the data."""
    t = at(spark, sf_dir)
    orders = t("orders")
    since = F.add_months(orders.agg(F.max("o_orderdate")).scalar().cast("date"), -12)
    recent = orders.filter(F.col("o_orderdate").cast("date") > since).select(F.col("o_custkey").alias("client"))
    return monitor.not_refreshed(t("customer").select(F.col("c_custkey").alias("client"), "c_name"), recent)


def latest_orders(spark, sf_dir):
    orders = at(spark, sf_dir)("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return latest_per_key(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


def size_class(spark, sf_dir):
    counted = filter_items(at(spark, sf_dir), ["state"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    rows = F.col("n") * 2000
    return counted.select(
        F.col("state").alias("demo_name"), rows.alias("how_many_rows"), labels.size_class(rows).alias("size"),
        labels.running_time(rows).alias("running_time"),
    )


def quartiles(spark, sf_dir):
    """Exact quartiles of the rows per user."""
    counted = filter_items(at(spark, sf_dir), ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("how_many_rows"))
    return exact_percentiles(counted, (), "how_many_rows", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def brand_ready(spark, sf_dir):
    t = at(spark, sf_dir)
    expected = t("supplier").select(
        F.col("s_name").alias("client_name"), F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("parent_brand")
    )
    return tidy(quality.brand_ready(filter_items(t, ["parent_brand", "brand", "gmv"]), expected))


def _retail_dates(days):
    """Order dates with their 4-5-4 month."""
    dated = days.withColumnRenamed("order_date", "cal_day").withColumn("retail_month_for_trailing", retail_month_of(F.col("cal_day")))
    columns = retail_month_columns(F.col("retail_month_for_trailing"))
    return dated.withColumns({c: columns[c] for c in ("retail_month_start", "retail_month_end")})


def calendar_check(spark, sf_dir):
    """4-5-4 months touched by orders and whether each maps to one trailing month."""
    return quality.calendar_check(_retail_dates(filter_items(at(spark, sf_dir), ["order_date"]).distinct().where("order_date is not null")))


def compare_calendars(spark, sf_dir):
    """First sale of each merchant per 4-5-4 month for the two panels side by side."""
    items = filter_items(at(spark, sf_dir), ["order_date", "merchant", "source"])
    sold = _retail_dates(items.groupBy("order_date", "merchant", "source").agg(F.lit(1).alias("n")).where("order_date is not null"))
    keys = ["merchant", "retail_month_start", "retail_month_end"]
    first, second = (
        sold.filter(F.col("source") == panel).groupBy(*keys).agg(F.min("cal_day").alias("date")) for panel in ("panel_a", "panel_b")
    )
    return compare.side_by_side(first, second, keys, "date")


def _config(t):
    rows = t("customer").select(
        F.concat(F.lit("client_"), F.col("c_custkey").cast("string")).alias("demo_name"),
        F.col("c_custkey").alias("how_many_rows"),
    )
    return client_config(inputs.config_form(t), "prospects_gold", rows)


def client_configuration(spark, sf_dir):
    shown = _config(at(spark, sf_dir)).withColumn("brands_display", F.array_join("brands_display", "|"))
    return shown.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def csv_config(spark, sf_dir):
    """The form written as CSV under its long questions, read back and renamed."""
    form = inputs.config_form(at(spark, sf_dir))
    question = "Short name of the client"
    target = warehouse_folder(spark, "config_csv")
    form.withColumnsRenamed({"demo_name": question, "timestamp": "Timestamp"}).write.mode("overwrite").csv(
        target, header=True, escape='"'
    )
    return read_config_csv(spark, target, {question: "demo_name", "Timestamp": "timestamp"})


QUERIES = {
    "dq_nulls": dq_nulls, "dq_negative": dq_negative, "dq_dates": dq_dates, "dq_blank": dq_blank,
    "dq_duplicates": dq_duplicates, "dq_date_formats": dq_date_formats, "nonnull_profile": nonnull_profile,
    "live_columns": live_columns, "standardize_attributes": standardize_attributes,
    "validate_attributes": validate_attributes, "attr_fill_rate": attr_fill_rate, "attr_top_values": attr_top_values,
    "attr_status": attr_status, "freshness": freshness, "freshness_profile": freshness_profile,
    "schema_report": schema_report, "except_all": except_all, "multiset_difference": multiset_difference,
    "compare_tables": compare_tables, "numeric_stats": numeric_stats, "compare_stats": compare_stats,
    "changes_table": changes_table, "pit_append": pit_append, "schema_change": schema_change,
    "null_type_repair": null_type_repair, "copy_check": copy_check, "run_status": run_status,
    "run_attempts": run_attempts, "latest_runs": latest_runs, "runs_per_hour": runs_per_hour,
    "not_refreshed": not_refreshed, "latest_per_key": latest_orders, "size_class": size_class, "quartiles": quartiles,
    "brand_ready": brand_ready, "calendar_check": calendar_check, "compare_calendars": compare_calendars,
    "client_config": client_configuration, "csv_config": csv_config,
}

# --- oracle -----------------------------------------------------------------------------------------


def _rows(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _null_row(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS total_rows, "
        f"coalesce(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100.0 / nullif(CAST(count(*) AS DOUBLE), 0), 0) AS null_percentage, "
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM items"
    )


def _negative_row(c: str, expression: str) -> str:
    high = f"coalesce(CAST(max({expression}) AS DOUBLE) > 50000, FALSE)" if c in ("item_price", "gmv") else "FALSE"
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {expression} < 0) AS negative_count, "
        f"CAST(min({expression}) AS DOUBLE) AS min_value, CAST(max({expression}) AS DOUBLE) AS max_value, "
        f"count({expression}) AS non_null_count, CAST(sum({expression}) AS DOUBLE) / count({expression}) AS avg_value, "
        f"CASE WHEN count(*) FILTER (WHERE {expression} < 0) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, "
        f"{high} AS high_value_warning FROM items"
    )


def _blank_row(c: str, expression: str) -> str:
    e, w = f"count(*) FILTER (WHERE {expression} = '')", f"count(*) FILTER (WHERE trim({expression}) = '')"
    return (
        f"SELECT '{c}' AS \"column\", {e} AS empty_count, {w} AS whitespace_count, "
        f"count(*) FILTER (WHERE {expression} IS NULL) AS null_count, count({expression}) AS non_null_count, "
        f"{e} + {w} AS total_empty_like, CASE WHEN {e} + {w} > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM items"
    )


def _duplicate_row(name: str, value: str, strict: bool) -> str:
    bad = "n - d > 0" if strict else "n - d > n * 0.01"
    return (
        f"SELECT '{name}' AS \"column\", n AS non_null_count, d AS distinct_count, n - d AS duplicate_count, "
        "coalesce(CAST(n - d AS DOUBLE) * 100.0 / nullif(CAST(n AS DOUBLE), 0), 0) AS duplicate_percentage, "
        f"CASE WHEN {bad} THEN 'WARNING' ELSE 'PASSED' END AS status "
        f"FROM (SELECT count({value}) AS n, count(DISTINCT {value}) AS d FROM items)"
    )


_TEXTS = """texts AS (
  SELECT CASE WHEN channel = 'ONLINE' THEN strftime(order_date, '%Y-%m-%d') WHEN finish = 'S' THEN strftime(order_date, '%m/%d/%Y')
              WHEN finish = 'M' THEN strftime(order_date, '%Y/%m/%d') WHEN finish = 'L' THEN strftime(order_date, '%Y-%m-%d') || ' 00:00:00'
              ELSE strftime(order_date, '%-d %b') END AS order_text,
         strftime(order_date, '%Y-%m-%dT%H:%M:%S') AS iso_text
  FROM items
)"""


def _format_row(c: str) -> str:
    spelled = "CASE " + " ".join(
        f"WHEN regexp_matches({c}, '{pattern}') THEN '{i}{name}'" for i, (name, pattern) in enumerate(quality.DATE_FORMATS)
    ) + " END"
    found = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {spelled} = '{i}{name}') > 0 THEN '{name}' END"
        for i, (name, _) in enumerate(quality.DATE_FORMATS)
    )
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} <> '') AS total_values,
       concat_ws(', ', {found}) AS formats_found,
       CAST(count(DISTINCT {spelled}) AS INTEGER) AS format_count,
       count(*) FILTER (WHERE {c} <> '') - count({spelled}) AS invalid_format_count,
       count(DISTINCT {spelled}) > 1 AS has_mixed_formats,
       CASE WHEN count(DISTINCT {spelled}) > 1 OR count(*) FILTER (WHERE {c} <> '') > count({spelled})
            THEN 'FAILED' ELSE 'PASSED' END AS status
FROM texts"""


_TAGGED = """tagged AS (
  SELECT merchant AS demo_name,
         coalesce(CASE WHEN finish IS NULL THEN '{"major_cat":"' || major_cat || '"}' END, attributes_json) AS attrs_json
  FROM items
)"""
RELEASES = (
    "base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)",
    "previous AS (SELECT * FROM base WHERE o_orderstatus <> 'P')",
    """current_rows AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice)
       FROM base WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))""",
)
_YEARS = (
    sql.ITEMS,
    """first_rows AS (SELECT year, brand, major_cat, count(*) AS sample_size, sum(item_quantity) AS units
       FROM items WHERE source = 'panel_a' GROUP BY ALL)""",
    """second_rows AS (SELECT year, brand, major_cat, count(*) AS sample_size, sum(item_quantity) AS units
       FROM items WHERE source = 'panel_b' GROUP BY ALL)""",
)
_LINES = (
    "first_rows AS (SELECT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem WHERE l_discount < 0.08)",
    "second_rows AS (SELECT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem WHERE l_discount > 0.02)",
)
_LINE = "l_returnflag, l_linestatus, l_quantity, l_linenumber"
_LOG = """log AS (
  SELECT event_id AS run_id, 'client_' || json_extract_string(props, '$.k') AS demo_name, ts AS end_timestamp, user_id AS "user",
         CASE WHEN event_type = 'error' THEN 'value ' || CAST(value AS VARCHAR) END AS error
  FROM events
)"""


def _stat_columns(c: str, suffix: str = "", where: str = "TRUE") -> str:
    f = f"FILTER (WHERE {where})"
    return (
        f"CAST(sum({c}) {f} AS DOUBLE) AS sum{suffix}, CAST(sum({c}) {f} AS DOUBLE) / count({c}) {f} AS avg{suffix}, "
        f"CAST(min({c}) {f} AS DOUBLE) AS min{suffix}, CAST(max({c}) {f} AS DOUBLE) AS max{suffix}, "
        f"round(stddev(CAST({c} AS DOUBLE)) {f}, 4) AS stddev{suffix}"
    )


_FORM = """form AS (
  SELECT 'client_' || CAST(o_custkey AS VARCHAR) AS demo_name,
         o_orderdate + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) + to_seconds(CAST((o_orderkey // 60) % 60 AS INTEGER)) AS "timestamp",
         CASE WHEN o_orderstatus = 'O' THEN 'prospects_gold' ELSE 'clients_gold' END AS prod_schema,
         CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || '|' || o_orderpriority ELSE o_orderpriority END AS brands_display,
         CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS start_date_of_data,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Market Share, Pro' WHEN '5-LOW' THEN 'Shopper Insights,Pricing & Promo' END AS packages,
         o_custkey
  FROM orders
)"""


def _has(label: str) -> str:
    return f"coalesce(list_contains(string_split(replace(packages, ', ', ','), ','), '{label}'), TRUE)"


# Accepted types of the item base and the order of its first columns (fixed values).
_MANDATORY_TYPES = {
    "order_date": "date timestamp string", "merchant": "string", "brand": "string",
    "item_price": "double float decimal int bigint", "item_quantity": "int bigint double float",
    "gmv": "double float decimal", "panel_flag": "string boolean int", "month": "date string int",
    "user_id": "string bigint int",
}
_OPTIONAL_TYPES = {
    "order_id": "string bigint int", "product_id": "string bigint int", "web_description": "string", "channel": "string",
    "source": "string", "year": "date int string", "factor_age": "float string int", "age": "string int double",
    "gender": "string", "region": "string", "state": "string", "panel_end_date": "date timestamp string",
    "full_price_estimate": "double float decimal", "category": "string", "subcategory": "string",
}
_FIRST_COLUMNS = ("order_date", "merchant", "month", "brand", "item_price", "item_quantity", "gmv", "panel_flag", "user_id")


def _schema_sql() -> str:
    """The item base described by DuckDB itself, held against the accepted types; counts from its rows."""
    def listed(types, kind):
        return [f"('{c}', '{accepted.replace(' ', '/')}', '{kind}')" for c, accepted in types.items()]

    accepted = ", ".join([*listed(_MANDATORY_TYPES, "mandatory"), *listed(_OPTIONAL_TYPES, "optional")])
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(_FIRST_COLUMNS))
    base = sql.with_(sql.ITEMS) + "SELECT * RENAME (attributes_json AS product_attributes) FROM items"
    return f"""WITH accepted (name, types, kind) AS (VALUES {accepted}),
wanted (name, place) AS (VALUES {order}),
described AS (
  SELECT column_name AS name, row_number() OVER () - 1 AS position,
         CASE WHEN column_name = 'product_attributes' THEN 'variant' WHEN column_type = 'VARCHAR' THEN 'string'
              WHEN column_type = 'INTEGER' THEN 'int' ELSE lower(column_type) END AS found
  FROM (DESCRIBE {base})
), counts AS (
  UNPIVOT (SELECT count(COLUMNS(*)) FROM ({base})) ON COLUMNS(*) INTO NAME name VALUE non_null_count
), typed AS (
  SELECT name, found, types, list_contains(string_split(types, '/'), string_split(found, '(')[1]) AS ok
  FROM described JOIN accepted USING (name)
), placed AS (
  SELECT name, position, row_number() OVER (ORDER BY place) - 1 AS expected FROM wanted JOIN described USING (name)
), findings AS (
  SELECT 'mandatory' AS "check", name, coalesce(found, 'missing') AS detail, found IS NOT NULL AS good, 'FAILED' AS bad
  FROM accepted LEFT JOIN described USING (name) WHERE kind = 'mandatory'
  UNION ALL SELECT 'type', name, CASE WHEN ok THEN found ELSE found || ', expected ' || types END, ok, 'FAILED' FROM typed
  UNION ALL SELECT 'optional', name, CASE WHEN found IS NULL THEN 'absent' ELSE 'present' END, TRUE, NULL
  FROM accepted LEFT JOIN described USING (name) WHERE kind = 'optional'
  UNION ALL SELECT 'order', name, 'position ' || position || ', expected ' || expected, position = expected, 'WARNING' FROM placed
  UNION ALL SELECT 'undocumented', name, found, FALSE, 'WARNING' FROM described ANTI JOIN accepted USING (name)
)
SELECT name AS "column", "check", detail, CASE WHEN good THEN 'PASSED' ELSE bad END AS status, non_null_count
FROM findings LEFT JOIN counts USING (name)"""


ORACLE = {
    "dq_nulls": sql.with_(sql.ITEMS) + _rows([_null_row(c) for c in ("order_date", "brand", "merchant", "item_price", "item_quantity", "gmv", "user_id", "web_description", "parent_brand")]),
    "dq_negative": sql.with_(sql.ITEMS) + _rows([
        _negative_row(c, "(gmv - item_price)" if c == "full_price_estimate" else c) for c in ("item_price", "gmv", "full_price_estimate", "item_quantity")]),
    "dq_dates": sql.with_(sql.ITEMS) + f"""SELECT 'order_date' AS "column", old AS too_old_count, new AS too_new_count, min_date, max_date,
       non_null_count, old + new AS total_invalid, CASE WHEN old + new > 0 THEN 'FAILED' ELSE 'PASSED' END AS status
FROM (SELECT count(*) FILTER (WHERE order_date < DATE '{EARLIEST}') AS old, count(*) FILTER (WHERE order_date > DATE '{LATEST}') AS new,
             min(order_date) AS min_date, max(order_date) AS max_date, count(order_date) AS non_null_count FROM items)""",
    "dq_blank": sql.with_(sql.ITEMS) + _rows([
        _blank_row("brand", "coalesce(parent_brand, '')"),
        _blank_row("merchant", "(CASE WHEN web_description IS NOT NULL THEN merchant ELSE '  ' END)"),
        *[_blank_row(c, f"CAST({c} AS VARCHAR)") for c in ("user_id", "order_id", "product_id")]]),
    "dq_duplicates": sql.with_(sql.ITEMS) + _rows([
        _duplicate_row("complete_row", "(order_id, user_id, brand, merchant_clean, channel, major_cat)", True),
        _duplicate_row("order_id", "order_id", True), _duplicate_row("user_id", "user_id", False)]),
    "dq_date_formats": sql.with_(sql.ITEMS, _TEXTS) + _rows([_format_row("order_text"), _format_row("iso_text")]),
    "nonnull_profile": sql.with_(sql.ITEMS) + _rows(
        [f"SELECT '{c}' AS \"column\", count({c}) AS non_null_count FROM items" for c in [*DQ_COLUMNS, "age", "channel"] if c != "user_id"]
        + ["SELECT 'gender' AS \"column\", CAST(0 AS BIGINT) AS non_null_count"]),
    "live_columns": sql.with_(sql.ITEMS) + "SELECT month, brand, finish, CAST(sum(gmv) AS DOUBLE) AS gmv FROM items GROUP BY ALL",
    "standardize_attributes": sql.with_(sql.ITEMS) + """SELECT coalesce(finish, 'N/A') AS finish, coalesce(parent_brand, 'N/A') AS parent_brand,
       major_cat, count(*) AS n_items, CAST(sum(gmv) AS DOUBLE) AS gmv FROM items GROUP BY ALL""",
    "validate_attributes": sql.with_(sql.ITEMS) + _rows([
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS total_count, "
        f"CASE WHEN count(*) > count({c}) THEN 'FAIL' ELSE 'PASS' END AS status FROM items" for c in ("finish", "brand")]
        + ["SELECT 'colour', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'MISSING'"]),
    "attr_fill_rate": sql.with_(sql.ITEMS, _TAGGED) + """SELECT demo_name, n AS total_records, f AS non_null_count, m AS marked_count, n - f AS null_count,
       CAST(f AS DOUBLE) * 100.0 / n AS fill_rate, coalesce(CAST(m AS DOUBLE) * 100.0 / nullif(f, 0), 0) AS marked_percentage
FROM (SELECT demo_name, count(*) AS n, count(attrs_json) AS f, count(*) FILTER (WHERE contains(attrs_json, 'major_cat')) AS m
      FROM tagged GROUP BY demo_name)""",
    "attr_top_values": sql.with_(sql.ITEMS, _TAGGED) + """SELECT attrs_json, count,
       round(CAST(count AS DOUBLE) * 100.0 / (SELECT count(attrs_json) FROM tagged), 2) AS percentage
FROM (SELECT attrs_json, count(*) AS count FROM tagged WHERE attrs_json IS NOT NULL GROUP BY 1) ORDER BY count DESC, attrs_json LIMIT 10""",
    "attr_status": sql.with_(sql.ITEMS, "n AS (SELECT count(*) AS a, count(attributes_json) AS f FROM items)")
    + """SELECT 'items' AS table_name, a AS rows, f AS filled, 'usable' AS verdict FROM n
UNION ALL SELECT 'items_as_text', a, f, 'other type' FROM n UNION ALL SELECT 'items_without', a - f, 0, 'empty' FROM n
UNION ALL SELECT 'orders', count(*), NULL, 'no column' FROM orders UNION ALL SELECT 'returns', NULL, NULL, 'no table'""",
    "freshness": sql.with_(sql.ITEMS, sql.MAPPING, """expected AS (
  SELECT merchant AS table_name FROM mapping UNION SELECT final_name || '_missing' FROM mapping)""",
        "newest AS (SELECT state, max(order_date) AS max_date FROM items GROUP BY state)") + """
SELECT table_name, DATE '2001-08-01' AS expected_date, max_date,
       CASE WHEN max_date IS NULL THEN 'TABLE_NOT_FOUND' WHEN max_date = DATE '2001-08-01' THEN 'OK'
            ELSE 'WRONG_DATE (expected: 2001-08-01)' END AS status
FROM expected LEFT JOIN newest ON table_name = state""",
    "freshness_profile": """SELECT event_type AS table_name, min(ts) AS first_update, max(ts) AS last_update,
       count(DISTINCT ts) AS unique_timestamps FROM events GROUP BY event_type""",
    "except_all": sql.with_(*_LINES) + f"""SELECT {_LINE}, count(*) AS copies
FROM (SELECT * FROM first_rows EXCEPT ALL SELECT * FROM second_rows) GROUP BY ALL""",
    "multiset_difference": sql.with_(*_LINES) + f"""SELECT {_LINE}, count(*) AS surplus, 'only_first' AS side
FROM (SELECT * FROM first_rows EXCEPT ALL SELECT * FROM second_rows) GROUP BY ALL
UNION ALL SELECT {_LINE}, count(*), 'only_second' FROM (SELECT * FROM second_rows EXCEPT ALL SELECT * FROM first_rows) GROUP BY ALL""",
    "compare_tables": sql.with_(*_YEARS, """counts AS (SELECT (SELECT count(*) FROM first_rows) AS rows_first,
       (SELECT count(*) FROM second_rows) AS rows_second,
       (SELECT count(*) FROM (SELECT * FROM first_rows EXCEPT ALL SELECT * FROM second_rows)) AS only_first,
       (SELECT count(*) FROM (SELECT * FROM second_rows EXCEPT ALL SELECT * FROM first_rows)) AS only_second)""")
    + """SELECT *, (SELECT any_value(typeof(first_rows)) FROM first_rows) = (SELECT any_value(typeof(second_rows)) FROM second_rows) AS schema_match,
       rows_first = rows_second AS row_count_match, only_first + only_second = 0 AS content_match,
       only_first + only_second = 0 AS identical FROM counts""",
    "numeric_stats": sql.with_(sql.ITEMS) + _rows([
        f"SELECT '{c}' AS \"column\", {_stat_columns(c)} FROM items" for c in ("item_price", "item_quantity", "gmv", "panel_flag")]),
    "compare_stats": sql.with_(sql.ITEMS) + _rows([
        f"SELECT '{c}' AS \"column\", {_stat_columns(c)}, {_stat_columns(c, '_second', "channel = 'ONLINE'")}, "
        f"(sum({c}), min({c}), max({c}), count({c})) IS NOT DISTINCT FROM (sum({c}) FILTER (channel = 'ONLINE'), "
        f"min({c}) FILTER (channel = 'ONLINE'), max({c}) FILTER (channel = 'ONLINE'), count({c}) FILTER (channel = 'ONLINE')) AS stats_match FROM items" for c in ("item_price", "item_quantity", "gmv")]),
    "changes_table": sql.with_(*RELEASES) + """SELECT o_orderkey, coalesce(n.o_custkey, p.o_custkey) AS o_custkey,
       coalesce(n.o_orderstatus, p.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, p.o_totalprice) AS o_totalprice,
       coalesce(n.o_orderpriority, p.o_orderpriority) AS o_orderpriority,
       CASE WHEN p.o_custkey IS NULL THEN 'INSERT' WHEN n.o_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS record_status
FROM previous p FULL JOIN current_rows n USING (o_orderkey)
WHERE p.o_custkey IS NULL OR n.o_custkey IS NULL
   OR (p.o_custkey, p.o_orderstatus, p.o_totalprice, p.o_orderpriority) IS DISTINCT FROM (n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderpriority)""",
    "pit_append": sql.with_(*RELEASES, """history AS (SELECT *, DATE '2024-01-01' AS publication_timestamp FROM previous
  UNION ALL SELECT *, DATE '2024-02-01' FROM current_rows)""") + _rows([
        f"""SELECT * EXCLUDE (rn), '{name}' AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY publication_timestamp DESC) AS rn
FROM history WHERE publication_timestamp <= DATE '{day}') WHERE rn = 1""" for name, day in (("between", "2024-01-15"), ("after", "2024-02-15"))]),
    "null_type_repair": sql.with_(sql.ITEMS) + """SELECT brand, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(NULL AS VARCHAR) AS gender,
       CAST(NULL AS VARCHAR) AS product_attributes FROM items GROUP BY brand""",
    "copy_check": """SELECT n AS source_rows, content AS source_content, n AS target_rows, content AS target_content, TRUE AS match
FROM (SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), '-'),
         coalesce(CAST(o_custkey AS VARCHAR), '-'), coalesce(o_orderstatus, '-'),
         coalesce(CAST(CAST(o_totalprice * 100 AS DECIMAL(20,0)) AS VARCHAR), '-'),
         coalesce(strftime(o_orderdate, '%Y-%m-%d'), '-'))), 1, 10) AS BIGINT)) AS BIGINT) AS content FROM orders)""",
    "schema_report": _schema_sql(),
    "run_status": sql.with_(_LOG, """summary AS (SELECT demo_name, count(*) AS runs_count, count(error) AS runs_with_error,
         min(end_timestamp) AS first_attempt, max(end_timestamp) AS last_attempt,
         arg_max("user", (end_timestamp, run_id)) AS "user" FROM log WHERE end_timestamp >= '2024-01-01' AND end_timestamp < '2024-02-01'
         GROUP BY demo_name)""", """last_error AS (SELECT demo_name, error FROM (SELECT *, row_number() OVER (PARTITION BY demo_name
         ORDER BY end_timestamp DESC, run_id DESC) AS rn FROM log WHERE end_timestamp >= '2024-01-01' AND end_timestamp < '2024-02-01') WHERE rn = 1)""",
        "good AS (SELECT demo_name, max(end_timestamp) AS last_successful_run FROM log WHERE error IS NULL GROUP BY demo_name)",
        """clients AS (SELECT 'client_' || json_extract_string(props, '$.k') AS demo_name,
         CASE WHEN sum(value) >= 2500 THEN 'Monthly' ELSE 'Quarterly' END AS frequency FROM events GROUP BY 1)""")
    + """SELECT c.demo_name AS args, "user", runs_count, runs_with_error,
       CASE WHEN runs_count IS NULL THEN 'needs_run' WHEN error IS NOT NULL THEN 'needs_fix'
            ELSE if(runs_with_error = 0, 'success', 'fixed') END AS status,
       left(error, 200) || CASE WHEN length(error) > 200 THEN '...' ELSE '' END AS error, last_successful_run, frequency,
       first_attempt, last_attempt
FROM clients c LEFT JOIN good USING (demo_name) LEFT JOIN summary USING (demo_name) LEFT JOIN last_error USING (demo_name)""",
    "run_attempts": sql.with_(_LOG) + """SELECT demo_name AS args, end_timestamp, "user", error FROM log
WHERE end_timestamp >= '2024-01-01' AND end_timestamp < '2024-02-01'""",
    "latest_runs": sql.with_(_LOG) + """SELECT demo_name, end_timestamp, run_id, "user", error FROM (SELECT *, row_number() OVER (
  PARTITION BY demo_name ORDER BY end_timestamp DESC, run_id DESC) AS rn FROM log WHERE end_timestamp > '2024-01-10') WHERE rn = 1""",
    "runs_per_hour": sql.with_(_LOG) + """SELECT CAST(floor(date_diff('second', TIMESTAMP '2024-01-02', date_trunc('second', end_timestamp)) / 3600.0) AS BIGINT) AS hour,
       count(*) AS runs, count(error) AS error_runs FROM log GROUP BY 1""",
    "not_refreshed": """SELECT c_custkey AS client, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
  AND o_orderdate > (SELECT max(o_orderdate) - INTERVAL 12 MONTH FROM orders))""",
    "latest_per_key": """SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "size_class": sql.with_(sql.ITEMS) + """SELECT state AS demo_name, n AS how_many_rows,
       CASE WHEN n >= 80266288 THEN 'very large' WHEN n >= 11915983 THEN 'large' WHEN n >= 4373925 THEN 'medium' ELSE 'small' END AS size,
       CASE WHEN n >= 80266288 THEN 100 WHEN n >= 11915983 THEN 45 WHEN n >= 4373925 THEN 40 ELSE 25 END AS running_time
FROM (SELECT state, count(*) * 2000 AS n FROM items GROUP BY state)""",
    "brand_ready": sql.with_(sql.ITEMS) + """SELECT 'Brand#' || CAST(s_nationkey AS VARCHAR) AS parent_brand, s_name AS client_name,
       CAST(gmv AS DOUBLE) AS gmv, gmv IS NOT NULL AS is_ready
FROM supplier LEFT JOIN (SELECT coalesce(parent_brand, brand) AS b, sum(gmv) AS gmv FROM items GROUP BY 1)
  ON b = 'Brand#' || CAST(s_nationkey AS VARCHAR)""",
    "calendar_check": sql.with_(sql.ITEMS, sql.RETAIL_CALENDAR) + """SELECT retail_month_start, count(DISTINCT retail_month_for_trailing) AS trailing_months,
       min(cal_day) AS first_day, max(cal_day) AS last_day, count(DISTINCT cal_day) AS days_in_month,
       count(DISTINCT retail_month_for_trailing) > 1 AS calendar_issue
FROM items JOIN retail_days ON order_date = cal_day GROUP BY retail_month_start""",
    "compare_calendars": sql.with_(sql.ITEMS, sql.RETAIL_CALENDAR,
        """sold AS (SELECT merchant, source, retail_month_start, retail_month_end, min(order_date) AS day
         FROM items JOIN retail_days ON order_date = cal_day GROUP BY ALL)""")
    + """SELECT merchant, retail_month_start, retail_month_end, first_date, second_date, CAST(first_date - second_date AS INTEGER) AS date_difference_days
FROM (SELECT merchant, retail_month_start, retail_month_end, min(CASE WHEN source = 'panel_a' THEN day END) AS first_date,
             min(CASE WHEN source = 'panel_b' THEN day END) AS second_date FROM sold GROUP BY ALL)""",
    "quartiles": sql.with_(sql.ITEMS) + """SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3
FROM (SELECT count(*) AS n FROM items GROUP BY user_id)""",
    "schema_change": sql.with_(sql.ITEMS) + """SELECT * FROM (VALUES ('brand', 'dropped', 'major'), ('major_cat', 'retyped', 'major'),
       ('super_brand', 'added', 'major')) AS v("column", change, version_step),
     (SELECT count(*) AS rows_previous FROM (SELECT DISTINCT state, major_cat, brand FROM items))""",
    "csv_config": """SELECT strftime(o_orderdate, '%-m/%-d/%Y ') || hour(o_orderdate) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':'
         || lpad(CAST((o_orderkey // 60) % 60 AS VARCHAR), 2, '0') AS "timestamp",
       'client_' || o_custkey AS demo_name, if(o_orderstatus = 'O', 'prospects_gold', 'clients_gold') AS prod_schema,
       if(o_orderstatus = 'O', format('[{0}O{0}, {0}{1}{0}]', chr(39), o_orderpriority), o_orderpriority) AS brands_display,
       if(o_orderstatus = 'O', strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d'), strftime(o_orderdate + INTERVAL 30 DAY, '%-m/%-d/%Y')) AS start_date_of_data,
       if(o_orderpriority = '1-URGENT', 'Market Share, Pro', if(o_orderpriority = '5-LOW', 'Shopper Insights,Pricing & Promo', NULL)) AS packages
FROM orders""",
    "client_config": sql.with_(_FORM) + f"""SELECT demo_name, "timestamp", prod_schema, brands_display, start_date_of_data, packages,
       prod_schema = 'prospects_gold' AS is_prospect, {_has('Market Share')} AS market_share, {_has('Shopper Insights')} AS shopper_insights,
       {_has('Pro')} AS pro_module, {_has('Pricing & Promo')} AS pricing_n_promo, o_custkey AS how_many_rows
FROM (SELECT *, row_number() OVER (PARTITION BY demo_name ORDER BY "timestamp" DESC) AS rn FROM form) WHERE rn = 1""",
}
