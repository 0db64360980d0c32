"""SQL fragments of the oracle queries: the derived inputs as common table expressions."""

from __future__ import annotations

ITEMS = """items AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(date_trunc('year', o_orderdate) AS DATE) AS year,
         o_custkey AS user_id, l_orderkey AS order_id, l_linenumber AS line_number,
         l_partkey AS sku, l_partkey AS product_id,
         CASE WHEN l_partkey % 50 <> 0 THEN p_name END AS web_description,
         CASE WHEN l_partkey % 40 <> 0 THEN p_brand END AS parent_brand,
         p_brand AS brand, p_brand || '-' || p_type AS sub_brand,
         p_type AS major_cat, split_part(p_name, ' ', 2) AS sub_cat, split_part(p_name, ' ', 2) AS minor_cat,
         sn.n_name AS merchant, sr.r_name AS merchant_clean,
         CASE WHEN l_returnflag = 'N' THEN 'ONLINE' ELSE 'B&M' END AS channel,
         cn.n_name AS state, cr.r_name AS region,
         CASE WHEN o_custkey % 3 <> 0 THEN 'panel_a' ELSE 'panel_b' END AS source,
         CAST(CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS panel_flag,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '18-24' WHEN 'BUILDING' THEN '25-34' WHEN 'FURNITURE' THEN '45-54'
              WHEN 'HOUSEHOLD' THEN '55-64' WHEN 'MACHINERY' THEN '65+' END AS age,
         CAST(l_quantity AS DECIMAL(12,2)) AS item_quantity,
         CAST(CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                   // (2 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS DECIMAL(18,2)) AS item_price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS gmv,
         CASE WHEN p_size = 1 THEN NULL WHEN p_size <= 15 THEN 'S' WHEN p_size <= 35 THEN 'M' ELSE 'L' END AS finish,
         CASE WHEN l_partkey % 7 <> 0
              THEN '{"p_size":' || CAST(p_size AS VARCHAR) || ',"p_type":"' || p_type || '"}' END AS attributes_json
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
)"""

MAPPING = """mapping AS (
  SELECT n_name AS merchant, r_name AS final_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""

# Day grain built by walking the days of each retail year; month grain by grouping it.
RETAIL_CALENDAR = """retail_starts AS (
  SELECT y, anchor + CAST(CASE WHEN d <= 3 THEN -d ELSE 7 - d END AS INTEGER) + 1 AS starts
  FROM (SELECT y, make_date(y, 1, 31) AS anchor, (dayofweek(make_date(y, 1, 31)) + 1) % 7 AS d
        FROM (SELECT CAST(unnest(range((SELECT year(min(o_orderdate)) - 1 FROM orders), (SELECT year(max(o_orderdate)) + 4 FROM orders))) AS INTEGER) AS y))
), retail_spans AS (
  SELECT y, starts, lead(starts) OVER (ORDER BY y) AS following FROM retail_starts
), retail_walk AS (
  SELECT y, starts, following,
         CAST(unnest(generate_series(starts, following - 1, INTERVAL 1 DAY)) AS DATE) AS cal_day
  FROM retail_spans WHERE following IS NOT NULL
), retail_weeks AS (
  SELECT *, CAST((cal_day - starts) // 7 AS INTEGER) AS w FROM retail_walk
), retail_quarters AS (
  SELECT *, least(w // 13, 3) AS q, w - 13 * least(w // 13, 3) AS wq FROM retail_weeks
), retail_numbers AS (
  SELECT *, CAST(3 * q + CASE WHEN wq < 4 THEN 1 WHEN wq < 9 THEN 2 ELSE 3 END AS INTEGER) AS month_number
  FROM retail_quarters
), retail_days AS (
  SELECT cal_day, y AS retail_year, month_number AS retail_month_number,
         CAST(q + 1 AS INTEGER) AS retail_quarter_rank,
         CAST(make_date(y, 2, 1) + (month_number - 1) * INTERVAL 1 MONTH AS DATE) AS retail_month_for_trailing,
         min(cal_day) OVER (PARTITION BY y, month_number) AS retail_month_start,
         max(cal_day) OVER (PARTITION BY y, month_number) AS retail_month_end,
         min(cal_day) OVER (PARTITION BY y, q) AS retail_quarter_start,
         max(cal_day) OVER (PARTITION BY y, q) AS retail_quarter_end,
         starts AS retail_year_start, following - 1 AS retail_year_end
  FROM retail_numbers
), retail_months AS (
  SELECT DISTINCT * EXCLUDE (cal_day) FROM retail_days
)"""

FISCAL = """fiscal AS (
  SELECT CAST(y AS VARCHAR) AS fiscal_year,
         CAST(q + 1 AS VARCHAR) || 'Q' || substr(CAST(y AS VARCHAR), 3, 2) AS fiscal_qtr,
         CAST(make_date(y, 2, 1) + (3 * q) * INTERVAL 1 MONTH AS DATE) AS start_date,
         CAST(make_date(y, 2, 1) + (3 * q + 3) * INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS end_date
  FROM (SELECT CAST(unnest(range((SELECT year(min(o_orderdate)) - 1 FROM orders), (SELECT year(max(o_orderdate)) + 2 FROM orders))) AS INTEGER) AS y), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS q)
)"""

FISCAL_ITEMS = """fiscal_items AS (
  SELECT items.*, fiscal_year, fiscal_qtr, substr(fiscal_year, 1, 4) || ' ' || substr(fiscal_qtr, 1, 2) AS quarter
  FROM items LEFT JOIN fiscal ON order_date BETWEEN start_date AND end_date
)"""

REPORT = """report AS (
  SELECT fiscal_year, fiscal_qtr, major_cat AS department, sub_cat AS class, coalesce(finish, 'N/A') AS sub_class,
         merchant, channel, brand, source, sum(gmv) AS gmv, sum(item_quantity) AS units, count(*) AS sample_size
  FROM fiscal_items GROUP BY ALL
)"""

PRICED = """priced AS (
  SELECT quarter, month, major_cat AS department, sub_cat AS class, coalesce(finish, 'N/A') AS sub_class, brand,
         CAST(sku AS VARCHAR) AS upc, web_description, merchant, channel, web_description AS product_description,
         item_price, item_quantity, gmv
  FROM fiscal_items
)"""

SHARE_KEYS = "channel, parent_brand, brand, sub_brand, merchant, major_cat, sub_cat, minor_cat, special_attribute"


def dense(day: str, source: str, named: bool, named_merchant: bool, start: str = "1995-01-01", attribute: str = "major_cat") -> str:
    """Gap-filled series, written the long way: every observed month opens the whole range of its key."""
    def brand(c):
        return f"coalesce({c}, 'unbranded') AS {c}" if named else c

    merchant = "coalesce(merchant_clean, 'no merchant')" if named_merchant else "merchant_clean"
    return f"""keyed AS (
  SELECT {day} AS seen, channel, {brand('parent_brand')}, {brand('brand')}, {brand('sub_brand')},
         {merchant} AS merchant, major_cat, sub_cat, minor_cat,
         coalesce(CAST({attribute} AS VARCHAR), major_cat) AS special_attribute, gmv, item_price, item_quantity
  FROM {source}
), grouped AS (
  SELECT seen, {SHARE_KEYS}, sum(gmv) AS gmv, count(*) AS sample_size,
         sum(item_price * item_quantity) AS iso, sum(item_quantity) AS iqo
  FROM keyed WHERE seen IS NOT NULL GROUP BY ALL
), bounded AS (
  SELECT *, min(seen) OVER k AS min_day, max(seen) OVER k AS max_day, (SELECT max(seen) FROM grouped) AS table_max
  FROM grouped WINDOW k AS (PARTITION BY {SHARE_KEYS})
), opened AS (
  SELECT *, CAST(unnest(generate_series(
              greatest(CAST(min_day - INTERVAL 12 MONTH AS DATE), DATE '{start}'),
              least(CAST(max_day + INTERVAL 12 MONTH AS DATE), table_max), INTERVAL 1 MONTH)) AS DATE) AS date
  FROM bounded
), dense AS (
  SELECT date, {SHARE_KEYS},
         sum(CASE WHEN seen = date THEN gmv ELSE 0 END) AS gmv,
         CAST(sum(CASE WHEN seen = date THEN sample_size ELSE 0 END) AS BIGINT) AS sample_size,
         sum(CASE WHEN seen = date THEN iso ELSE 0 END) AS iso,
         sum(CASE WHEN seen = date THEN iqo ELSE 0 END) AS iqo
  FROM opened GROUP BY ALL
)"""


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def units(gmv: str, iso: str, iqo: str) -> str:
    return f"(CAST({gmv} AS DOUBLE) / nullif({ratio(iso, iqo)}, 0))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
