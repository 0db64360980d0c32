"""Inputs of the marts derived from the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import age_cohort
from aislewise.functions.periods import floor_to
from aislewise.operators.grouping import scalar
from aislewise.plans.brands import quarter_of, with_fiscal_quarter
from aislewise.plans.leakage import USER_PARTS
from aislewise.sources.items import filter_items
from aislewise.sources.tables import Tables


def retailer_mapping(tables: Tables) -> DataFrame:
    """Raw merchant to final name, many to one."""
    nation, region = tables("nation"), tables("region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select(F.col("n_name").alias("merchant"), F.col("r_name").alias("final_name"))


def state_names(tables: Tables) -> DataFrame:
    readable = F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")))
    return tables("nation").select(F.col("n_name").alias("state"), readable.alias("state_name"))


def _ordered(tables: Tables) -> DataFrame:
    return tables("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("order_date")
    )


def annual_users(tables: Tables) -> DataFrame:
    """Users with at least two orders in a year."""
    orders = _ordered(tables).withColumn("year", floor_to("year", F.col("order_date")))
    return orders.groupBy("user_id", "year").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2).drop("n")


def rolling_users(tables: Tables) -> DataFrame:
    """Users with an order in the last 24 months."""
    orders = _ordered(tables)
    since = F.add_months(scalar(orders, F.max("order_date")), -24)
    return orders.filter(F.col("order_date") > since).select("user_id").distinct()


def household_weights(tables: Tables, cycle: int) -> DataFrame:
    """Household-size factor per year and cohort present in the item base."""
    seen = filter_items(tables, ["year", "age"]).select(F.year("year").alias("y"), age_cohort(F.col("age")).alias("age_cohort"))
    factor = (F.lit(1) + (F.col("y") % cycle) / F.lit(10)).cast("decimal(4,2)")
    return seen.distinct().select(F.col("y").cast("string").alias("year"), "age_cohort", factor.alias("hh_size_adj_factor"))


def _visits(tables: Tables) -> DataFrame:
    """Merchant, source and quarter of every item, dealt by user: one shuffle for all that reads them."""
    items = filter_items(tables, ["user_id", "merchant", "source", "order_date"])
    visits = items.select("user_id", "merchant", "source", floor_to("quarter", F.col("order_date")).alias("quarter"))
    return visits.repartition(USER_PARTS, "user_id")


def retail_users(tables: Tables) -> DataFrame:
    """First active quarter of a user at a merchant within a source."""
    return _visits(tables).groupBy("user_id", "merchant", "source").agg(F.min("quarter").alias("first_active_quarter"))


def panelists(tables: Tables, by_source: bool) -> DataFrame:
    """Distinct users per merchant and quarter, and per source if asked."""
    keys = ["merchant", "quarter", *(["source"] if by_source else [])]
    # All columns are read either way, which lets both sizes share the shuffle.
    return _visits(tables).distinct().groupBy(*keys).agg(F.count_distinct("user_id").alias("total_users"))


def pro_items(tables: Tables) -> DataFrame:
    """Items bought by professional buyers, with the columns of the pro source."""
    columns = ["merchant", "web_description", "brand", "month", "order_id", "line_number", "item_quantity", "gmv", "age"]
    items = filter_items(tables, columns).filter(F.col("age") == "25-34").drop("age")
    return items.withColumn("brand", F.upper("brand")).withColumnRenamed("web_description", "product_description")


def priced_items(tables: Tables, lots: int | None = None) -> DataFrame:
    """Items with fiscal quarter and category numbers' columns used by the price marts, dealt by ``sku`` in ``lots``."""
    columns = [
        "order_date", "month", "sku", "web_description", "brand", "merchant", "channel", "major_cat", "sub_cat", "finish",
        "item_price", "item_quantity", "gmv",
    ]
    dated = with_fiscal_quarter(filter_items(tables, columns, lots=lots))
    return dated.select(
        quarter_of(F.col("fiscal_year"), F.col("fiscal_qtr")).alias("quarter"),
        "month",
        F.col("major_cat").alias("department"),
        F.col("sub_cat").alias("class"),
        F.coalesce("finish", F.lit("N/A")).alias("sub_class"),
        "brand",
        "sku",
        F.col("sku").cast("string").alias("upc"),
        "web_description",
        "merchant",
        "channel",
        F.col("web_description").alias("product_description"),
        "item_price",
        "item_quantity",
        "gmv",
    )


# Name of the job in the derived run log.
JOB = "monthly_marts"


def run_log(tables: Tables) -> DataFrame:
    """Job runs as a telemetry table keeps them: arguments as a JSON array, error text or NULL."""
    key = F.get_json_object("props", "$.k")
    return tables("events").select(
        F.col("event_id").alias("run_id"),
        F.lit(JOB).alias("name"),
        F.concat(F.lit('["client_'), key, F.lit('"]')).alias("args"),
        F.col("ts").alias("end_timestamp"),
        F.col("user_id").alias("user"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("value "), F.col("value").cast("string"))).alias("error"),
    )


def log_clients(tables: Tables) -> DataFrame:
    """Clients named in the run log with their delivery frequency."""
    key = F.get_json_object("props", "$.k")
    heavy = F.sum("value") >= 2500
    return tables("events").groupBy(F.concat(F.lit("client_"), key).alias("demo_name")).agg(
        F.when(heavy, "Monthly").otherwise("Quarterly").alias("frequency")
    )


def config_form(tables: Tables) -> DataFrame:
    """Client form submissions: one per order, in the text formats a form produces."""
    date = F.col("o_orderdate")
    late = F.date_add(date.cast("date"), 30)
    open_order = F.col("o_orderstatus") == "O"
    return tables("orders").select(
        F.concat(
            F.date_format(date, "M/d/yyyy"), F.lit(" "), F.expr("hour(o_orderdate)").cast("string"), F.lit(":"),
            F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad((F.floor(F.col("o_orderkey") / 60) % 60).cast("string"), 2, "0"),
        ).alias("timestamp"),
        F.concat(F.lit("client_"), F.col("o_custkey").cast("string")).alias("demo_name"),
        F.when(open_order, "prospects_gold").otherwise("clients_gold").alias("prod_schema"),
        F.when(open_order, F.concat(F.lit("['"), "o_orderstatus", F.lit("', '"), "o_orderpriority", F.lit("']")))
        .otherwise(F.col("o_orderpriority"))
        .alias("brands_display"),
        F.when(open_order, F.date_format(late, "yyyy-MM-dd")).otherwise(F.date_format(late, "M/d/yyyy")).alias(
            "start_date_of_data"
        ),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Market Share, Pro")
        .when(F.col("o_orderpriority") == "5-LOW", "Shopper Insights,Pricing & Promo")
        .alias("packages"),
    )


def releases(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Two releases of the orders table with inserted, updated and deleted rows between them."""
    orders = tables("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    previous = orders.filter(F.col("o_orderstatus") != "P")
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    raised = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))
    return previous, orders.filter(~gone).withColumn("o_totalprice", raised)
