"""Product marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.plans import market_share as ms
from aislewise.plans import sku
from aislewise.registry import sql
from aislewise.registry.common import START_DATE, at, dates, tidy
from aislewise.sources.items import filter_items

SHOWN = [*sku.KEYS, "display_interval", "product_id_type", "period_starting", "max_date", "parent_brand", "total_spend",
         "total_units", "gmv", "observations", "last_obs", "last_gmv", "new_sku_flag"]
NAMES = {
    "sku_annual": "Last Year", "sku_ytd": "Year-To-Date", "sku_quarter": "Last Quarter", "sku_month": "Last Month",
    "sku_t12": "Trailing 12 Months",
}


def _analysis(t, intervals):
    items = filter_items(t, sku.ITEM_COLUMNS, lots=sku.PRODUCT_PARTS)
    return sku.sku_analysis(items, intervals, dates=dates(t), dealt=True)


def _interval(name):
    def query(spark, sf_dir):
        return tidy(_analysis(at(spark, sf_dir), [NAMES[name]]).select(*SHOWN))

    return query


def sku_analysis_all(spark, sf_dir):
    """All five intervals in one pass."""
    return tidy(_analysis(at(spark, sf_dir), sku.INTERVALS).select(*SHOWN))


def sku_time_series(spark, sf_dir):
    t = at(spark, sf_dir)
    items = filter_items(t, sku.ITEM_COLUMNS, lots=sku.PRODUCT_PARTS)
    series = sku.sku_time_series(items, dates=dates(t), dealt=True)
    shown = ["period_month" if c == "period_starting" else c for c in SHOWN]
    return tidy(series.select(*shown, "first_observation_in_month", "last_observation_in_month"))


def sku_attributes(spark, sf_dir):
    """Product attributes packed into a variant per product key and month, shown as JSON text."""
    t = at(spark, sf_dir)
    items = filter_items(t, [*sku.ITEM_COLUMNS, "finish", "region"], lots=sku.PRODUCT_PARTS)
    series = sku.sku_time_series(items, ["finish", "region"], dates=dates(t), dealt=True)
    packed = F.to_json("product_attributes")
    return series.groupBy("brand", packed.alias("attributes_json"), F.schema_of_variant("product_attributes").alias("kind")).agg(
        F.count(F.lit(1)).alias("product_months"),
        F.count(F.variant_get("product_attributes", "$.finish", "string")).alias("with_finish"),
    )


def sku_scorecard(spark, sf_dir):
    card = sku.sku_scorecard(_analysis(at(spark, sf_dir), ["Year-To-Date"]))
    return tidy(card.drop("product_hash"))


def product_hash(spark, sf_dir):
    t = at(spark, sf_dir)
    items = filter_items(t, ["web_description", "brand", "merchant", "sku", "gmv"])
    digest = sku.product_hash(F.col("web_description"), F.col("brand"), F.col("merchant"), F.col("sku"))
    return tidy(
        items.groupBy(digest.alias("product_hash")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("gmv").alias("gmv"))
    )


def first_seen(spark, sf_dir):
    return sku.first_seen(filter_items(at(spark, sf_dir), ["sku", "order_date"]))


def reconcile_gmv(spark, sf_dir):
    t = at(spark, sf_dir)
    share = ms.market_share_dense(filter_items(t, ms.ITEM_COLUMNS, START_DATE), "major_cat", START_DATE)
    columns = ["month", "order_date", "web_description", "merchant_clean", "major_cat", "gmv"]
    return tidy(sku.reconcile_gmv(filter_items(t, columns), share, dates(t)))


QUERIES = {
    **{name: _interval(name) for name in NAMES},
    "sku_analysis": sku_analysis_all,
    "sku_time_series": sku_time_series,
    "sku_attributes": sku_attributes,
    "sku_scorecard": sku_scorecard,
    "product_hash": product_hash,
    "first_seen": first_seen,
    "reconcile_gmv": reconcile_gmv,
}

# --- oracle -----------------------------------------------------------------------------------------

# Product key of the marts (fixed value).
_KEYS = "channel, major_cat, sub_cat, minor_cat, web_description, merchant, brand, sub_brand, product_id"
_BASE = (
    sql.ITEMS,
    "newest AS (SELECT max(month) AS last FROM items)",
    f"""sold AS (
  SELECT {{{", ".join(f"'{k}': {'merchant_clean' if k == 'merchant' else k}" for k in _KEYS.split(", "))}}} AS product,
         month, order_date, parent_brand, item_price * item_quantity AS spend, item_quantity, gmv, last
  FROM items CROSS JOIN newest WHERE web_description IS NOT NULL
)""",
)
_SHOWN = ", ".join(f"now.product.{k} AS {k}" for k in _KEYS.split(", "))


def _compared(label: str, begins: str, season: str, kept: str, shown: str, reported: str, starting: str = "now.begins",
              named: str = "period_starting", extra: str = "") -> str:
    """Periods of a product beside the latest comparable one before, by a join of periods with periods.

    ``begins`` is the first day of the period that a sale counts for; periods of equal ``season`` compare.
    """
    return f"""WITH periods AS (
  SELECT product, {begins} AS begins, {season} AS season, min(parent_brand) AS parent_brand, sum(spend) AS total_spend,
         sum(item_quantity) AS total_units, sum(gmv) AS gmv, count(*) AS observations, min(order_date) AS opened,
         max(order_date) AS closed
  FROM sold WHERE {kept} GROUP BY ALL
), chosen AS (
  SELECT periods.*, last FROM periods CROSS JOIN newest WHERE {shown}
), comparable AS (
  SELECT c.product, c.begins, max(p.begins) AS earlier
  FROM chosen c JOIN periods p ON p.product = c.product AND p.season = c.season AND p.begins < c.begins
  GROUP BY c.product, c.begins
), debut AS (
  SELECT product, min(begins) AS begins FROM periods GROUP BY product
)
SELECT {_SHOWN}, '{label}' AS display_interval, 'sku' AS product_id_type, CAST({starting} AS DATE) AS {named},
       CAST({reported} AS DATE) AS max_date, now.parent_brand, CAST(now.total_spend AS DOUBLE) AS total_spend,
       CAST(now.total_units AS DOUBLE) AS total_units, CAST(now.gmv AS DOUBLE) AS gmv, now.observations,
       before.observations AS last_obs, CAST(before.gmv AS DOUBLE) AS last_gmv,
       CAST(debut.product IS NOT NULL AS INTEGER) AS new_sku_flag{extra}
FROM chosen now
LEFT JOIN comparable ON comparable.product = now.product AND comparable.begins = now.begins
LEFT JOIN periods before ON before.product = now.product AND before.begins = comparable.earlier
LEFT JOIN debut ON debut.product = now.product AND debut.begins = now.begins"""


_INTERVALS = {
    # The last complete year, any earlier year before it.
    "sku_annual": _compared(
        "Last Year", "make_date(year(month), 1, 1)", "0", "year(month) < year(last)", "year(begins) = year(last) - 1",
        "make_date(year(last) - 1, 12, 1)"),
    # The running year, years cut after the month of the newest one.
    "sku_ytd": _compared(
        "Year-To-Date", "make_date(year(month), 1, 1)", "0", "month(month) <= month(last)", "year(begins) = year(last)", "last"),
    # The last complete quarter, the same quarter of an earlier year.
    "sku_quarter": _compared(
        "Last Quarter", "make_date(year(month), 3 * quarter(month) - 2, 1)", "quarter(month)",
        "4 * year(month) + quarter(month) < 4 * year(last) + quarter(last)",
        "4 * year(begins) + quarter(begins) = 4 * year(last) + quarter(last) - 1",
        "make_date(year(last), 3 * quarter(last) - 2, 1) - 1"),
    "sku_month": _compared("Last Month", "month", "month(month)", "TRUE", "begins = last", "last"),
    # Twelve months up to the newest one against the twelve before them.
    "sku_t12": _compared(
        "Trailing 12 Months", "CAST(last - to_months(CAST(11 + 12 * (datediff('month', month, last) // 12) AS INTEGER)) AS DATE)",
        "0", "datediff('month', month, last) < 24", "datediff('month', begins, last) = 11", "last"),
}

_SERIES = _compared(
    "Monthly Time Series", "month", "0", "TRUE", "TRUE", "last", named="period_month",
    extra=", now.opened AS first_observation_in_month, now.closed AS last_observation_in_month")


def _after_base(text: str) -> str:
    return sql.with_(*_BASE) + f"SELECT * FROM ({text})"


ORACLE = {
    **{name: _after_base(text) for name, text in _INTERVALS.items()},
    "sku_analysis": _after_base("\nUNION ALL ".join(f"SELECT * FROM ({text})" for text in _INTERVALS.values())),
    "sku_time_series": _after_base(_SERIES),
    "sku_attributes": sql.with_(sql.ITEMS) + f"""
SELECT brand, '{{' || concat_ws(',', '"finish":"' || finish || '"', '"region":"' || region || '"') || '}}' AS attributes_json,
       'OBJECT<' || concat_ws(', ', CASE WHEN finish IS NOT NULL THEN 'finish: STRING' END,
                                CASE WHEN region IS NOT NULL THEN 'region: STRING' END) || '>' AS kind,
       count(*) AS product_months, count(finish) AS with_finish
FROM (SELECT {_KEYS.replace("merchant", "merchant_clean")}, month, min(finish) AS finish, min(region) AS region
      FROM items WHERE web_description IS NOT NULL GROUP BY ALL)
GROUP BY 1, 2, 3""",
    "sku_scorecard": sql.with_(*_BASE, f"ytd AS ({_INTERVALS['sku_ytd']})", """card AS (
  SELECT merchant, brand, web_description, product_id, min(major_cat) AS major_category, min(sub_cat) AS sub_category,
         min(minor_cat) AS minor_category, sum(CAST(gmv AS DECIMAL(28,4))) AS total_gmv,
         CAST(sum(last_obs) AS BIGINT) AS sum_last_obs, sum(CAST(last_gmv AS DECIMAL(28,4))) AS last_year_gmv,
         CAST(sum(CAST(total_spend AS DECIMAL(28,4))) AS DOUBLE)
           / nullif(CAST(sum(CAST(total_units AS DECIMAL(28,2))) AS DOUBLE), 0) AS asp,
         CAST(sum(observations) AS BIGINT) AS sample_size
  FROM ytd GROUP BY merchant, brand, web_description, product_id
)""") + """SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv, CAST(last_year_gmv AS DOUBLE) AS last_year_gmv),
       CAST(total_gmv AS DOUBLE) / nullif(asp, 0) AS units,
       CASE WHEN sample_size > 1000 THEN 'Low Risk' WHEN sample_size > 250 THEN 'Some Risk' ELSE 'High Risk' END AS ssr,
       CASE WHEN sample_size > 1000 AND sum_last_obs > 500
            THEN CAST(total_gmv AS DOUBLE) / nullif(CAST(last_year_gmv AS DOUBLE), 0) - 1 END AS yoy_growth
FROM card""",
    "product_hash": sql.with_(sql.ITEMS) + """
SELECT md5(coalesce(web_description, '') || coalesce(brand, '') || coalesce(merchant, '')
           || coalesce(CAST(sku AS VARCHAR), '')) AS product_hash,
       count(*) AS n_items, CAST(sum(gmv) AS DOUBLE) AS gmv
FROM items GROUP BY 1""",
    "first_seen": sql.with_(sql.ITEMS) + "SELECT sku, min(order_date) AS first_appearance FROM items GROUP BY sku",
    "reconcile_gmv": sql.with_(sql.ITEMS, sql.dense("month", "items", False, False), """by_item AS (
  SELECT merchant_clean AS merchant, major_cat, sum(gmv) AS item_gmv,
         sum(CASE WHEN web_description IS NOT NULL THEN gmv END) AS sku_gmv,
         coalesce(sum(CASE WHEN web_description IS NULL THEN gmv END), 0) AS undescribed_gmv
  FROM items WHERE month = (SELECT max(month) FROM items) GROUP BY ALL
)""", """by_share AS (
  SELECT merchant, major_cat, sum(gmv) AS share_gmv FROM dense WHERE date = (SELECT max(month) FROM items) GROUP BY ALL
)""") + """SELECT i.merchant, i.major_cat, CAST(item_gmv AS DOUBLE) AS item_gmv, CAST(sku_gmv AS DOUBLE) AS sku_gmv,
       CAST(undescribed_gmv AS DOUBLE) AS undescribed_gmv, CAST(share_gmv AS DOUBLE) AS share_gmv,
       CAST(share_gmv - sku_gmv AS DOUBLE) AS gmv_gap
FROM by_item i LEFT JOIN by_share s ON i.merchant IS NOT DISTINCT FROM s.merchant
 AND i.major_cat IS NOT DISTINCT FROM s.major_cat""",
}
