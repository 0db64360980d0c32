"""Queries whose operators keep large or unbounded inputs apart: buckets, bins, rules, sketches, pages, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.operators import digests, paging, profile, quality, rules, variants
from aislewise.operators.range_join import range_join
from aislewise.plans.medians import rolling_medians
from aislewise.registry import checks, sql
from aislewise.registry.common import at, tidy
from aislewise.sources import inputs
from aislewise.sources.items import filter_items
from aislewise.sources.sinks import copy_files


def compare_buckets(spark, sf_dir):
    """Rows in which two releases of the orders differ, on both sides."""
    return digests.compare_buckets(*inputs.releases(at(spark, sf_dir)), ["o_orderkey"])


def contracts_in_force(spark, sf_dir):
    """Every order with the urgent orders of its customer that ran then: as many days as they cost thousands, or without end."""
    orders = at(spark, sf_dir)("orders")
    days = F.make_dt_interval(F.floor(F.col("o_totalprice") / 1000).cast("int"))
    contracts = orders.filter("o_orderpriority = '1-URGENT'").select(
        "o_custkey", F.col("o_orderkey").alias("contract"), F.col("o_orderdate").alias("signed"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + days).alias("ended"),
    )
    found = range_join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), contracts, "o_orderdate", "signed", "ended", ["o_custkey"])
    return found.select("o_orderkey", "contract")


def events_in_incidents(spark, sf_dir):
    """Events between an error and as many seconds later as its value says, at the grain of a microsecond."""
    events = at(spark, sf_dir)("events")
    lasting = F.col("ts") + F.make_dt_interval(secs=F.round("value", 6).cast("decimal(18,6)"))
    incidents = events.filter("event_type = 'error'").select(F.col("event_id").alias("incident"), F.col("ts").alias("began"), lasting.alias("over"))
    return range_join(events.select("event_id", "ts"), incidents, "ts", "began", "over", how="inner").select("event_id", "incident")


def taxonomy_rules(spark, sf_dir):
    """The taxonomy read from a table of rules, its exceptions a list of products that grows with the catalogue."""
    t = at(spark, sf_dir)
    fixed = [
        (1, "sub_cat", "exact", "bolt", "Hardware"), (1, "sub_cat", "exact", "rod", "Hardware"), (1, "sub_cat", "exact", "gear", "Hardware"),
        (2, "major_cat", "exact", "PROMO", "Promoted Home"), (2, "web_description", "pattern", "plate|ring", "Promoted Home"),
        (4, "sub_cat", "exact", "plate", "Home"), (4, "sub_cat", "exact", "ring", "Home"),
        (5, "web_description", "contains", "RED", "Red"),
    ]
    kinds = "priority int, column string, kind string, value string, label string"
    exceptions = t("part").filter("p_size = 7").select(
        F.lit(3).alias("priority"), F.lit("sku").alias("column"), F.lit("exact").alias("kind"),
        F.col("p_partkey").cast("string").alias("value"), F.lit("Exceptions").alias("label"),
    )
    items = filter_items(t, ["sub_cat", "major_cat", "web_description", "sku", "gmv"])
    named = rules.labelled(items, spark.createDataFrame(fixed, kinds).unionByName(exceptions), "minor_cat_prep", "Other")
    return tidy(named.groupBy("minor_cat_prep", "major_cat").agg(F.count(F.lit(1)).alias("n_items"), F.sum("gmv").alias("gmv")))


def rolling_medians_checked(spark, sf_dir):
    """Values behind each four-quarter median and whether its rank is as near to one half as promised."""
    items = filter_items(at(spark, sf_dir), ["major_cat", "order_date", "item_price"])
    quarterly = items.withColumn("quarter", F.trunc("order_date", "quarter"))
    return rolling_medians(quarterly, ["major_cat"], "quarter", "item_price").select("major_cat", "quarter", "n_values", "within")


def _ranked_items(spark, sf_dir):
    items = tidy(filter_items(at(spark, sf_dir), ["order_id", "line_number", "sku", "merchant", "gmv"]))
    ties = ["order_id", "line_number", "sku", "merchant"]
    return paging.numbered(items, [F.desc("gmv"), *ties])


def export_pages(spark, sf_dir):
    """All items, dearest first, with their row number and page of 25,001 rows."""
    return paging.pages(_ranked_items(spark, sf_dir), 25001)


def export_page(spark, sf_dir):
    """The third page of 1,000 rows of the same export."""
    return paging.page(_ranked_items(spark, sf_dir), 3, 1000)


def _part_attributes(spark, sf_dir):
    part = at(spark, sf_dir)("part")
    mixed = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    text = F.concat(
        F.lit('{"size":'), F.col("p_size").cast("string"), F.lit(',"type":"'), "p_type", F.lit('","mixed":'), mixed,
        F.lit(',"made":{"brand":"'), "p_brand", F.lit('"}}'),
    )
    return part.select("p_partkey", F.parse_json(F.when(F.col("p_partkey") % 7 != 0, text)).alias("attributes"))


def typed_attributes(spark, sf_dir):
    """Product attributes as typed columns; what has no single type stays together."""
    typed = variants.typed_columns(_part_attributes(spark, sf_dir), "attributes")
    return typed.withColumn("rest", F.to_json("rest"))


def attribute_types(spark, sf_dir):
    """Keys of the product attributes with their merged type."""
    return variants.variant_keys(_part_attributes(spark, sf_dir), "attributes")


def sampled_profile(spark, sf_dir):
    """Null shares from half of the files of the item base, sorted so that nulls cluster, held against all rows."""
    columns = ["order_id", "line_number", "sku", "parent_brand", "web_description", "finish"]
    items = filter_items(at(spark, sf_dir), columns).sort("finish", "sku")
    with_files = copy_files(items, "profile_items", rows_per_file=10_000)
    found = profile.sampled_profile(with_files, 0.5).join(quality.nonnull_profile(with_files), "column")
    off = F.abs(F.col("null_share") - (F.col("table_rows") - F.col("non_null_count")) / F.col("table_rows"))
    return found.select("column", "table_rows", "non_null_count", (off <= F.col("error_bound")).alias("within_bound"))


QUERIES = {
    "compare_buckets": compare_buckets,
    "contracts_in_force": contracts_in_force,
    "events_in_incidents": events_in_incidents,
    "taxonomy_rules": taxonomy_rules,
    "rolling_medians": rolling_medians_checked,
    "export_pages": export_pages,
    "export_page": export_page,
    "typed_attributes": typed_attributes,
    "attribute_types": attribute_types,
    "sampled_profile": sampled_profile,
}

_RANKED = """ranked AS (
  SELECT order_id, line_number, sku, merchant, CAST(gmv AS DOUBLE) AS gmv,
         row_number() OVER (ORDER BY gmv DESC, order_id NULLS FIRST, line_number NULLS FIRST, sku NULLS FIRST, merchant NULLS FIRST) AS row_number
  FROM items
)"""

ORACLE = {
    "sampled_profile": sql.with_(sql.ITEMS) + """SELECT "column", (SELECT count(*) FROM items) AS table_rows, non_null_count, TRUE AS within_bound
FROM (UNPIVOT (SELECT count(order_id) AS order_id, count(line_number) AS line_number, count(sku) AS sku, count(parent_brand) AS parent_brand,
                      count(web_description) AS web_description, count(finish) AS finish FROM items)
      ON COLUMNS(*) INTO NAME "column" VALUE non_null_count)""",
    "compare_buckets": sql.with_(*checks.RELEASES)
    + """SELECT *, 'only_first' AS side, count(*) AS surplus FROM (SELECT * FROM previous EXCEPT ALL SELECT * FROM current_rows) GROUP BY ALL
UNION ALL
SELECT *, 'only_second' AS side, count(*) AS surplus FROM (SELECT * FROM current_rows EXCEPT ALL SELECT * FROM previous) GROUP BY ALL""",
    "contracts_in_force": """SELECT o.o_orderkey, c.o_orderkey AS contract FROM orders o
LEFT JOIN orders c ON c.o_orderpriority = '1-URGENT' AND c.o_custkey = o.o_custkey AND o.o_orderdate >= c.o_orderdate
  AND (c.o_orderstatus = 'O' OR o.o_orderdate <= c.o_orderdate + CAST(floor(c.o_totalprice / 1000) AS INTEGER) * INTERVAL 1 DAY)""",
    "events_in_incidents": """SELECT e.event_id, i.event_id AS incident FROM events e
JOIN events i ON i.event_type = 'error' AND epoch_us(e.ts) BETWEEN epoch_us(i.ts) AND epoch_us(i.ts) + CAST(round(i.value * 1000000) AS BIGINT)""",
    "taxonomy_rules": sql.with_(sql.ITEMS) + """SELECT CASE WHEN sub_cat IN ('bolt', 'rod', 'gear') THEN 'Hardware'
            WHEN major_cat = 'PROMO' AND regexp_matches(lower(web_description), 'plate|ring') THEN 'Promoted Home'
            WHEN sku IN (SELECT p_partkey FROM part WHERE p_size = 7) THEN 'Exceptions' WHEN sub_cat IN ('plate', 'ring') THEN 'Home'
            WHEN contains(lower(web_description), 'red') THEN 'Red' ELSE 'Other' END AS minor_cat_prep,
       major_cat, count(*) AS n_items, CAST(sum(gmv) AS DOUBLE) AS gmv FROM items GROUP BY 1, 2""",
    "rolling_medians": sql.with_(
        sql.ITEMS,
        "quarterly AS (SELECT major_cat, CAST(date_trunc('quarter', order_date) AS DATE) AS quarter FROM items WHERE item_price IS NOT NULL)",
        "quarters AS (SELECT quarter, row_number() OVER (ORDER BY quarter) AS pos FROM (SELECT DISTINCT quarter FROM quarterly WHERE quarter IS NOT NULL))",
        "placed AS (SELECT major_cat, pos FROM quarterly JOIN quarters USING (quarter))",
    )
    + """SELECT major_cat, q.quarter, count(*) AS n_values, true AS within
FROM quarters q JOIN placed p ON p.pos BETWEEN q.pos - 3 AND q.pos GROUP BY ALL""",
    "export_pages": sql.with_(sql.ITEMS, _RANKED) + "SELECT *, CAST((row_number - 1) // 25001 + 1 AS BIGINT) AS page FROM ranked",
    "export_page": sql.with_(sql.ITEMS, _RANKED) + "SELECT * FROM ranked WHERE row_number BETWEEN 2001 AND 3000",
    "typed_attributes": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS size,
  CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS type,
  CASE WHEN p_partkey % 7 <> 0 THEN '{"made":{"brand":"' || p_brand || '"},"mixed":'
    || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '"' || p_name || '"' END || '}' END AS rest
FROM part""",
    "attribute_types": """SELECT key, type, n_rows FROM (VALUES ('size', 'BIGINT'), ('type', 'STRING'), ('mixed', 'VARIANT'), ('made', 'OBJECT<brand: STRING>')) AS t(key, type),
  (SELECT count(*) AS n_rows FROM part WHERE p_partkey % 7 <> 0)""",
}
