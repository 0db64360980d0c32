"""Item base, filters, joins, aggregates and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aislewise.functions import labels, predicates
from aislewise.functions.measures import ratio
from aislewise.functions.periods import end_of, floor_to
from aislewise.operators.grouping import hier_agg, null_safe_join
from aislewise.plans.brands import with_fiscal_quarter
from aislewise.registry import sql
from aislewise.registry.common import at, tidy
from aislewise.sources.calendars import fiscal_quarters
from aislewise.sources.items import ITEM_COLUMNS, filter_items

LINE = ["order_id", "line_number"]


def item_base(spark, sf_dir):
    items = filter_items(at(spark, sf_dir))
    return tidy(items.withColumn("product_attributes", F.to_json("product_attributes")))


def hier_aggregate(spark, sf_dir):
    keys = ["month", "channel", "brand", "merchant_clean", "major_cat", "sub_cat"]
    items = filter_items(at(spark, sf_dir), [*keys, "gmv", "item_price", "item_quantity"])
    out = hier_agg(items, keys)
    return tidy(out.withColumn("asp", ratio(F.col("item_subtotal_observed"), F.col("item_quantity_observed"))))


def page_filter(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "brand", "parent_brand", "major_cat", "channel", "gmv"])
    choices = {"parent_brand": ["Brand#1", "Brand#2", "Brand#25"], "major_cat": ["SMALL", "PROMO"], "channel": [], "brand": None}
    return tidy(predicates.page_filter(items, choices))


GROUPS = [
    {"conditions": [
        {"field_name": "merchant_clean", "values": ["asia"], "condition_operator": "NOT IN"},
        {"field_name": "brand", "values": ["BRAND#3", "brand#4", "Brand#5"]},
    ]},
    {"condition_operator": "OR", "conditions": [
        {"field_name": "major_cat", "values": ["Economy"]},
        {"field_name": "sub_cat", "values": ["Bolt", "Rod"]},
    ]},
]


def condition_groups(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "merchant_clean", "brand", "major_cat", "sub_cat"])
    return items.filter(predicates.condition_groups(GROUPS))


def date_range_filter(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "order_date"])
    ranges = {
        "both": (dt.date(1997, 3, 1), dt.date(1998, 3, 1)), "from": (dt.date(2000, 1, 1), None),
        "until": (None, dt.date(1996, 1, 1)), "open": (None, None),
    }
    tests = [F.count_if(predicates.between_optional("order_date", *r)).alias(n) for n, r in ranges.items()]
    return items.groupBy(floor_to("year", F.col("order_date")).alias("year")).agg(*tests)


def text_search(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "web_description", "merchant"])
    found = items.filter(predicates.has_text("web_description", "BOLT") | predicates.has_pattern("web_description", "^(red|blue) .*g"))
    return found


def _taxonomy():
    return labels.first_match(
        [
            (F.col("sub_cat").isin("bolt", "rod", "gear"), "Hardware"),
            ((F.col("major_cat") == "PROMO") & predicates.has_pattern("web_description", "plate|ring"), "Promoted Home"),
            (F.col("sku").isin(10, 20, 30), "Exceptions"),
            (F.col("sub_cat").isin("plate", "ring"), "Home"),
        ],
        "Other",
    )


def taxonomy(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["sub_cat", "major_cat", "web_description", "sku", "gmv"])
    return tidy(
        items.withColumn("minor_cat_prep", _taxonomy())
        .groupBy("minor_cat_prep", "major_cat")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sum("gmv").alias("gmv"))
    )


def brand_any_level(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["parent_brand", "brand", "sub_brand", "merchant", "gmv"])
    hit = predicates.any_level(["parent_brand", "brand", "sub_brand"], "Brand#7")
    return tidy(items.filter(hit).groupBy("parent_brand", "brand", "sub_brand", "merchant").agg(F.sum("gmv").alias("gmv")))


def fiscal_range_join(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "order_date"])
    years = items.agg(F.min(F.year("order_date")), F.max(F.year("order_date"))).first()
    return with_fiscal_quarter(items, fiscal_quarters(spark, years[0] - 1, years[1]))


def null_safe(spark, sf_dir):
    """Totals per nullable category pair joined with those of online sales, NULL matching NULL."""
    keys = ["parent_brand", "finish"]
    items = filter_items(at(spark, sf_dir), [*keys, "channel", "gmv"])
    total = items.groupBy(*keys).agg(F.sum("gmv").alias("gmv"))
    online = items.filter(F.col("channel") == "ONLINE").groupBy(*keys).agg(F.sum("gmv").alias("online_gmv"))
    return tidy(null_safe_join(total, online, keys))


def fn_string(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "brand", "sub_brand", "web_description", "merchant"])
    text = F.col("web_description")
    return items.select(
        *LINE,
        F.upper("brand").alias("upper_brand"),
        F.substring("sub_brand", 7, 4).alias("brand_number"),
        F.left(text, F.lit(3)).alias("head"),
        F.trim(F.concat(F.lit("  "), text, F.lit(" "))).alias("trimmed"),
        F.length(text).alias("text_length"),
        F.position(F.lit("r"), text).alias("first_r"),
        text.like("%ring%").alias("is_ring"),
        F.md5(F.concat(F.coalesce(text, F.lit("")), "merchant")).alias("digest"),
        labels.clean_brand(F.col("brand")).alias("clean_brand"),
    )


def fn_date(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["order_date"])
    day = F.col("order_date")
    text = F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 7:05:09"))
    parsed = F.to_timestamp_ntz(text, F.lit("M/d/yyyy H:mm:ss"))
    newest = items.agg(F.max("order_date")).scalar()
    return items.groupBy("order_date").agg(F.count(F.lit(1)).alias("n_items")).select(
        "order_date", "n_items",
        floor_to("week", day).alias("week_start"), floor_to("month", day).alias("month_start"), end_of("month", day).alias("month_end"),
        floor_to("quarter", day).alias("quarter_start"), end_of("quarter", day).alias("quarter_end"), end_of("year", day).alias("year_end"),
        F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m"), F.day(day).alias("d"),
        F.add_months(day, -12).alias("year_before"), F.date_add(day, -13).alias("days_before"),
        (day - F.expr("interval 11 month")).cast("date").alias("window_start"),
        F.datediff(newest, day).alias("age_days"),
        F.months_between(F.trunc(newest, "month"), F.trunc(day, "month")).cast("int").alias("age_months"),
        (F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed)).alias("parsed_seconds"),
        F.timestamp_diff("HOUR", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), parsed).alias("hours_since"),
    )


def fn_array(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), ["brand", "sub_cat", "month", "finish"])
    months = F.sequence(F.lit(0), F.lit(2))
    arrays = items.groupBy("brand", "sub_cat").agg(
        F.collect_set("finish").alias("finishes"), F.min("month").alias("first_month"), F.count(F.lit(1)).alias("n_items")
    )
    return arrays.select("brand", "sub_cat", "n_items", "finishes", "first_month", F.posexplode(months).alias("at", "shift")).select(
        "brand", "sub_cat", "n_items", "at",
        F.add_months("first_month", F.col("shift")).alias("month"),
        F.array_join(F.array_sort("finishes", lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), ", ").alias("finish_list"),
        F.size(F.array_compact(F.array(F.lit(None).cast("string"), F.get("finishes", F.lit(0))))).alias("compacted"),
        F.array_join(F.transform(F.array_sort("finishes"), lambda x: F.lower(x)), "").alias("lowered"),
        F.array_size("finishes").alias("n_finishes"),
    )


def fn_json(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "product_attributes", "finish", "brand"])
    variant = F.col("product_attributes")
    keys = F.map_keys(F.from_json(F.to_json(variant), "map<string,string>"))
    return items.select(
        *LINE,
        F.to_json(variant).alias("attributes_json"),
        F.variant_get(variant, "$.p_size", "int").alias("p_size"),
        F.get_json_object(F.to_json(variant), "$.p_type").alias("p_type"),
        F.array_join(keys, ",").alias("keys"),
        F.to_json(F.struct("brand", "finish")).alias("packed"),
        F.to_json(variant).contains("p_type").alias("has_type"),
    )


def fn_conditional(spark, sf_dir):
    items = filter_items(at(spark, sf_dir), [*LINE, "finish", "parent_brand", "brand", "item_quantity", "item_price", "age", "channel"])
    quantity, price = F.col("item_quantity"), F.col("item_price")
    return tidy(
        items.select(
            *LINE,
            labels.brand_or(labels.UNBRANDED, F.col("parent_brand")).alias("named_brand"),
            labels.brand_or("Unbranded", F.col("brand"), ["Brand#1"]).alias("known_brand"),
            F.coalesce("finish", F.lit("N/A")).alias("finish"),
            F.isnull("finish").alias("no_finish"),
            F.least(quantity, F.lit(10)).cast("double").alias("least_quantity"),
            F.greatest(price, F.lit(1000)).cast("double").alias("greatest_price"),
            ratio(price, F.nullif(quantity, F.lit(25))).alias("nullif_ratio"),
            F.expr("try_cast(finish as int)").alias("not_a_number"),
            F.round(price, 0).cast("double").alias("rounded_price"),
            labels.age_cohort(F.col("age")).alias("cohort"),
            labels.channel_title(F.col("channel")).alias("channel_title"),
        )
    )


QUERIES = {
    "filter_items": item_base, "hier_agg": hier_aggregate, "page_filter": page_filter, "condition_groups": condition_groups,
    "date_range_filter": date_range_filter, "text_search": text_search, "taxonomy": taxonomy,
    "brand_any_level": brand_any_level, "fiscal_range_join": fiscal_range_join, "null_safe_join": null_safe,
    "fn_string": fn_string, "fn_date": fn_date, "fn_array": fn_array, "fn_json": fn_json, "fn_conditional": fn_conditional,
}

# --- oracle -----------------------------------------------------------------------------------------

_COLUMNS = ", ".join(
    {"product_attributes": "attributes_json AS product_attributes"}.get(
        c, f"CAST({c} AS DOUBLE) AS {c}" if c in ("item_quantity", "item_price", "gmv") else c
    )
    for c in ITEM_COLUMNS
)
_W = sql.with_(sql.ITEMS)

ORACLE = {
    "filter_items": _W + f"SELECT {_COLUMNS} FROM items",
    "hier_agg": _W + f"""SELECT month, channel, brand, merchant_clean, major_cat, sub_cat, CAST(sum(gmv) AS DOUBLE) AS gmv,
       count(*) AS sample_size, CAST(sum(item_price * item_quantity) AS DOUBLE) AS item_subtotal_observed,
       CAST(sum(item_quantity) AS DOUBLE) AS item_quantity_observed,
       {sql.ratio('sum(item_price * item_quantity)', 'sum(item_quantity)')} AS asp
FROM items GROUP BY month, channel, brand, merchant_clean, major_cat, sub_cat""",
    "page_filter": _W + """SELECT order_id, line_number, brand, parent_brand, major_cat, channel, CAST(gmv AS DOUBLE) AS gmv
FROM items WHERE parent_brand IN ('Brand#1', 'Brand#2', 'Brand#25') AND major_cat IN ('SMALL', 'PROMO')""",
    "condition_groups": _W + """SELECT order_id, line_number, merchant_clean, brand, major_cat, sub_cat FROM items
WHERE trim(lower(merchant_clean)) NOT IN ('asia') AND trim(lower(brand)) IN ('brand#3', 'brand#4', 'brand#5')
  AND (trim(lower(major_cat)) IN ('economy') OR trim(lower(sub_cat)) IN ('bolt', 'rod'))""",
    "date_range_filter": _W + """SELECT year, count(*) FILTER (WHERE order_date >= DATE '1997-03-01' AND order_date < DATE '1998-03-01') AS both,
       count(*) FILTER (WHERE order_date >= DATE '2000-01-01') AS "from", count(*) FILTER (WHERE order_date < DATE '1996-01-01') AS until,
       count(*) AS open FROM items GROUP BY year""",
    "text_search": _W + """SELECT order_id, line_number, web_description, merchant FROM items
WHERE lower(web_description) LIKE '%bolt%' OR regexp_matches(lower(web_description), '^(red|blue) .*g')""",
    "taxonomy": _W + """SELECT CASE WHEN sub_cat IN ('bolt', 'rod', 'gear') THEN 'Hardware'
            WHEN major_cat = 'PROMO' AND regexp_matches(lower(web_description), 'plate|ring') THEN 'Promoted Home'
            WHEN sku IN (10, 20, 30) THEN 'Exceptions' WHEN sub_cat IN ('plate', 'ring') THEN 'Home' ELSE 'Other' END AS minor_cat_prep,
       major_cat, count(*) AS n_items, CAST(sum(gmv) AS DOUBLE) AS gmv FROM items GROUP BY 1, 2""",
    "brand_any_level": _W + """SELECT parent_brand, brand, sub_brand, merchant, CAST(sum(gmv) AS DOUBLE) AS gmv FROM items
WHERE parent_brand = 'Brand#7' OR brand = 'Brand#7' OR sub_brand = 'Brand#7' GROUP BY 1, 2, 3, 4""",
    "fiscal_range_join": sql.with_(sql.ITEMS, sql.FISCAL) + """SELECT order_id, line_number, order_date, fiscal_qtr, fiscal_year
FROM items LEFT JOIN fiscal ON order_date BETWEEN start_date AND end_date""",
    "null_safe_join": sql.with_(sql.ITEMS, "total AS (SELECT parent_brand, finish, sum(gmv) AS gmv FROM items GROUP BY ALL)",
        "online AS (SELECT parent_brand, finish, sum(gmv) AS g FROM items WHERE channel = 'ONLINE' GROUP BY ALL)") + """
SELECT t.parent_brand, t.finish, CAST(gmv AS DOUBLE) AS gmv, CAST(g AS DOUBLE) AS online_gmv FROM total t LEFT JOIN online o
  ON coalesce(t.parent_brand, '') = coalesce(o.parent_brand, '') AND (t.parent_brand IS NULL) = (o.parent_brand IS NULL)
 AND coalesce(t.finish, '') = coalesce(o.finish, '') AND (t.finish IS NULL) = (o.finish IS NULL)""",
    "fn_string": _W + """SELECT order_id, line_number, upper(brand) AS upper_brand, substr(sub_brand, 7, 4) AS brand_number,
       left(web_description, 3) AS head, trim('  ' || web_description || ' ') AS trimmed, CAST(length(web_description) AS INTEGER) AS text_length,
       CAST(position('r' IN web_description) AS INTEGER) AS first_r, web_description LIKE '%ring%' AS is_ring,
       md5(coalesce(web_description, '') || merchant) AS digest, coalesce(upper(brand), 'UNBRANDED') AS clean_brand FROM items""",
    "fn_date": _W + """SELECT order_date, count(*) AS n_items, CAST(date_trunc('week', order_date) AS DATE) AS week_start,
       CAST(date_trunc('month', order_date) AS DATE) AS month_start, last_day(order_date) AS month_end,
       CAST(date_trunc('quarter', order_date) AS DATE) AS quarter_start,
       CAST(date_trunc('quarter', order_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
       make_date(year(order_date), 12, 31) AS year_end, CAST(year(order_date) AS INTEGER) AS y, CAST(quarter(order_date) AS INTEGER) AS q,
       CAST(month(order_date) AS INTEGER) AS m, CAST(day(order_date) AS INTEGER) AS d,
       CAST(order_date - INTERVAL 12 MONTH AS DATE) AS year_before, order_date - 13 AS days_before,
       CAST(order_date - INTERVAL 11 MONTH AS DATE) AS window_start,
       CAST((SELECT max(order_date) FROM items) - order_date AS INTEGER) AS age_days,
       CAST(date_diff('month', order_date, (SELECT max(order_date) FROM items)) AS INTEGER) AS age_months,
       CAST(7 * 3600 + 5 * 60 + 9 AS INTEGER) AS parsed_seconds, (order_date - DATE '1995-01-01') * 24 + 7 AS hours_since
FROM items GROUP BY order_date""",
    "fn_array": _W + """SELECT brand, sub_cat, n_items, CAST(shift AS INTEGER) AS at, CAST(first_month + shift * INTERVAL 1 MONTH AS DATE) AS month,
       coalesce(down, '') AS finish_list, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS INTEGER) AS compacted, coalesce(up, '') AS lowered, CAST(n AS INTEGER) AS n_finishes
FROM (SELECT brand, sub_cat, count(*) AS n_items, min(month) AS first_month, count(DISTINCT finish) AS n,
             string_agg(DISTINCT finish, ', ' ORDER BY finish DESC) AS down, string_agg(DISTINCT lower(finish), '' ORDER BY lower(finish)) AS up
      FROM items GROUP BY 1, 2), (SELECT unnest([0, 1, 2]) AS shift)""",
    "fn_json": _W + """SELECT order_id, line_number, attributes_json, CAST(json_extract_string(attributes_json, '$.p_size') AS INTEGER) AS p_size,
       json_extract_string(attributes_json, '$.p_type') AS p_type, array_to_string(json_keys(attributes_json), ',') AS keys,
       '{"brand":"' || brand || '"' || coalesce(',"finish":"' || finish || '"', '') || '}' AS packed,
       contains(attributes_json, 'p_type') AS has_type FROM items""",
    "fn_conditional": _W + f"""SELECT order_id, line_number, coalesce(parent_brand, 'unbranded') AS named_brand,
       CASE WHEN brand = 'Brand#1' THEN 'Unbranded' ELSE brand END AS known_brand, coalesce(finish, 'N/A') AS finish, finish IS NULL AS no_finish,
       CAST(least(item_quantity, 10) AS DOUBLE) AS least_quantity, CAST(greatest(item_price, 1000) AS DOUBLE) AS greatest_price,
       {sql.ratio('item_price', 'nullif(item_quantity, 25)')} AS nullif_ratio, TRY_CAST(finish AS INTEGER) AS not_a_number,
       CAST(round(item_price, 0) AS DOUBLE) AS rounded_price,
       CASE WHEN age IN ('55-64', '65+') THEN 'boomer_plus' WHEN age = '45-54' THEN 'gen_x' WHEN age IN ('35-44', '25-34') THEN 'millenial'
            WHEN age IN ('21-24', '18-20', '18-24') THEN 'gen_z' END AS cohort,
       CASE WHEN channel = 'B&M' THEN 'In-Store' WHEN channel = 'ONLINE' THEN 'Online' END AS channel_title
FROM items""",
}
