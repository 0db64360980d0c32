"""Market share and its displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.periods import DISPLAY_INTERVALS, interval_start
from aislewise.operators.densify import trailing_gaps
from aislewise.operators.grouping import hier_agg
from aislewise.plans import display as view
from aislewise.plans import market_share as ms
from aislewise.registry import sql
from aislewise.registry.common import START_DATE, at, dates, rounded, tidy
from aislewise.sources.items import filter_items

TRAILING = [c for c in ms.METRIC_COLUMNS if "trailing" in c]
BASE = ["gmv", "units", "sample_size", "item_subtotal_observed", "item_quantity_observed"]


def mart_report(mart, key="brand"):
    """The mart summed over categories: every row of it counts, the result stays small enough to compare."""
    by = [*ms.CALENDAR_COLUMNS, "channel", key]
    sums = [F.sum(c).alias(c) for c in (*BASE, *TRAILING)]
    filled = [F.count(f"gmv_trailing_{s}m").alias(f"full_windows_{s}m") for s in (3, 6, 12)]
    out = mart.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums, *filled)
    return rounded(tidy(out), [c for c in (*BASE, *TRAILING) if c.startswith("units")])


def _items(t, columns=ms.ITEM_COLUMNS):
    return filter_items(t, columns, START_DATE)


def _dense(t):
    return ms.market_share_dense(_items(t), "major_cat", START_DATE)


def market_share_std(spark, sf_dir):
    t = at(spark, sf_dir)
    return mart_report(ms.market_share(_items(t), "major_cat", START_DATE, "standard"))


def market_share_454(spark, sf_dir):
    t = at(spark, sf_dir)
    return mart_report(ms.market_share(_items(t), "major_cat", START_DATE, "454"))


def row_digests(mart):
    """One row per key of the mart: its months, and a sum of hashes over all columns of all its rows.

    The hash of a row covers calendar, key and metrics, so two errors cannot cancel as they might in sums.
    """
    numbers = ["gmv", "units", "item_subtotal_observed", *[c for c in TRAILING if not c.startswith("sample")]]
    texts = [
        F.coalesce((F.round(c, 4) * 10000).cast("bigint").cast("string") if c in numbers else F.col(c).cast("string"), F.lit("-"))
        for c in (*ms.CALENDAR_COLUMNS, *ms.KEYS, *ms.METRIC_COLUMNS)
    ]
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 12), 16, 10).cast("bigint")
    return mart.groupBy(*ms.KEYS).agg(
        F.count(F.lit(1)).alias("months"), F.min("date").alias("first_month"), F.max("date").alias("last_month"),
        F.sum(hashed).alias("row_hashes"),
    )


def _rows(calendar):
    """Every row of the mart at its own grain."""
    def query(spark, sf_dir):
        return row_digests(ms.market_share(_items(at(spark, sf_dir)), "major_cat", START_DATE, calendar))

    return query


def _by_attribute(calendar):
    """Market share of a special attribute, items without one under their category."""
    def query(spark, sf_dir):
        items = _items(at(spark, sf_dir), [*ms.ITEM_COLUMNS, "finish"])
        return mart_report(ms.market_share(items, "finish", START_DATE, calendar), "special_attribute")

    return query


def market_share_dense(spark, sf_dir):
    t = at(spark, sf_dir)
    out = _dense(t).groupBy("trunc_day", "parent_brand", "merchant", "major_cat").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(c).alias(c) for c in ("gmv", "sample_size", "item_subtotal_observed", "item_quantity_observed")],
    )
    return tidy(out)


def display_intervals(spark, sf_dir):
    """Periods each display interval offers for the months of the item base."""
    months = dates(at(spark, sf_dir)).select(F.trunc("order_date", "month").alias("month")).distinct()
    shown = [
        F.struct(F.lit(i).alias("display_interval"), interval_start(i, F.col("month")).alias("display_time"))
        for i in DISPLAY_INTERVALS
    ]
    offered = (
        months.select(F.inline(F.array(*shown)))
        .groupBy("display_interval")
        .agg(
            F.count_distinct("display_time").alias("periods"),
            F.min("display_time").alias("first_period"),
            F.max("display_time").alias("last_period"),
        )
    )
    return ms.display_interval_table(spark).join(offered, "display_interval", "left")


VIEWS = {
    "share_display_month": view.ShareView(interval="Monthly", level="sub", top=5, min_sample=94),
    "share_display_quarter": view.ShareView(interval="Quarterly", level="major", metric="Units", top=4, min_sample=380),
    "share_display_ytd": view.ShareView(
        interval="Year-to-Date", level="sub", as_share=True, top=6, min_sample=500, ytd_max_month=3,
        choices={"merchant": ["ASIA", "EUROPE"], "major_cat": []},
    ),
    "share_display_t12": view.ShareView(interval="Trailing 12 Months", level="minor", top=5, min_sample=1130),
}


def _display(name):
    def query(spark, sf_dir):
        shown = view.share_display(_dense(at(spark, sf_dir)), VIEWS[name])
        digits = 6 if VIEWS[name].as_share else 4
        return rounded(rounded(tidy(rounded(shown, ["units"])), ["units_perc"], 6), ["display_metric"], digits)

    return query


def guardrail(spark, sf_dir):
    return tidy(view.sample_guardrail(_dense(at(spark, sf_dir)), VIEWS["share_display_month"]))


def risk_message(spark, sf_dir):
    v = VIEWS["share_display_month"]
    return view.risk_message(view.share_display(_dense(at(spark, sf_dir)), v))


GAP_KEYS = ["channel", "brand", "merchant_clean", "major_cat"]


def trailing_gap_rows(spark, sf_dir):
    t = at(spark, sf_dir)
    series = hier_agg(_items(t, ["month", *GAP_KEYS, "gmv", "item_price", "item_quantity"]), ["month", *GAP_KEYS])
    return tidy(trailing_gaps(series.select("month", *GAP_KEYS, "gmv"), GAP_KEYS, "month"))


QUERIES = {
    "market_share_std": market_share_std,
    "market_share_454": market_share_454,
    "market_share_rows": _rows("standard"),
    "market_share_rows_454": _rows("454"),
    "market_share_attribute": _by_attribute("standard"),
    "market_share_attribute_454": _by_attribute("454"),
    "market_share_dense": market_share_dense,
    "display_intervals": display_intervals,
    **{name: _display(name) for name in VIEWS},
    "guardrail": guardrail,
    "risk_message": risk_message,
    "trailing_gaps": trailing_gap_rows,
}


# --- oracle -----------------------------------------------------------------------------------------

def _trailing_sql() -> str:
    """Sums over the last months on the calendar, where every one of those months has a row."""
    def column(c, span):
        return f"CASE WHEN count(*) OVER w{span} = {span} THEN sum({c}) OVER w{span} END AS {c}_trailing_{span}m"

    return ", ".join(column(c, span) for span in (3, 6, 12) for c in ("sample_size", "units", "gmv"))


def _windows_sql() -> str:
    frame = "w{0} AS (PARTITION BY {1} ORDER BY date RANGE BETWEEN INTERVAL {2} MONTH PRECEDING AND CURRENT ROW)"
    return ", ".join(frame.format(span, sql.SHARE_KEYS, span - 1) for span in (3, 6, 12))


_PRICED_UNITS = f"""measured AS (
  SELECT *, CAST({sql.units('gmv', 'iso', 'iqo')} AS DECIMAL(36,8)) AS units FROM dense
)"""

_REPORT_SELECT = (
    ["count(*) AS n_rows"]
    + ["CAST(sum(gmv) AS DOUBLE) AS gmv", "CAST(round(sum(units), 4) AS DOUBLE) AS units",
       "CAST(sum(sample_size) AS BIGINT) AS sample_size", "CAST(sum(iso) AS DOUBLE) AS item_subtotal_observed",
       "CAST(sum(CAST(iqo AS INTEGER)) AS BIGINT) AS item_quantity_observed"]
    + [f"CAST(sum({c}) AS {'BIGINT' if c.startswith('sample') else 'DOUBLE'}) AS {c}" if not c.startswith("units")
       else f"CAST(round(sum({c}), 4) AS DOUBLE) AS {c}" for c in TRAILING]
    + [f"count(gmv_trailing_{s}m) AS full_windows_{s}m" for s in (3, 6, 12)]
)
_STD_CALENDAR = """date AS month_start, last_day(date) AS month_end, CAST(month(date) AS INTEGER) AS month,
         CAST(date_trunc('quarter', date) AS DATE) AS quarter_start,
         CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
         CAST(quarter(date) AS INTEGER) AS quarter, CAST(date_trunc('year', date) AS DATE) AS year_start,
         CAST(date_trunc('year', date) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS year_end,
         CAST(year(date) AS INTEGER) AS year, max(date) OVER () AS max_date"""


_CALENDAR = ("date", "month_start", "month_end", "month", "quarter_start", "quarter_end", "quarter", "year_start", "year_end",
             "year", "max_month", "max_quarter", "max_date")


def _report_sql(source: str, key: str) -> str:
    by = ", ".join([*_CALENDAR, "channel", key])
    return f"SELECT {by}, " + ",\n       ".join(_REPORT_SELECT) + f"\nFROM {source} GROUP BY {by}"


def _rows_sql(source: str) -> str:
    def text(c):
        if c == "item_subtotal_observed":
            return "CAST(CAST(round(iso, 4) * 10000 AS BIGINT) AS VARCHAR)"
        if c == "item_quantity_observed":
            return "CAST(CAST(iqo AS INTEGER) AS VARCHAR)"
        if c.startswith(("gmv", "units")):
            return f"coalesce(CAST(CAST(round({c}, 4) * 10000 AS BIGINT) AS VARCHAR), '-')"
        return f"coalesce(CAST({c} AS VARCHAR), '-')"

    measures = ["gmv", "units", "sample_size", "item_subtotal_observed", "item_quantity_observed"]
    measures += [f"{m}_trailing_{n}m" for m in ("gmv", "units", "sample_size") for n in (3, 6, 12)]
    row = " || '|' || ".join(text(c) for c in [*_CALENDAR, *sql.SHARE_KEYS.split(", "), *measures])
    return f"""SELECT {sql.SHARE_KEYS}, count(*) AS months, min(date) AS first_month, max(date) AS last_month,
       CAST(sum(CAST('0x' || substr(md5({row}), 1, 12) AS BIGINT)) AS BIGINT) AS row_hashes
FROM {source} GROUP BY ALL"""


def _standard_sql(attribute: str, key: str | None) -> str:
    return sql.with_(
        sql.ITEMS,
        sql.dense("month", "items", True, True, attribute=attribute),
        _PRICED_UNITS,
        f"dated AS (SELECT *, {_STD_CALENDAR} FROM measured)",
        f"""mart AS (
  SELECT *, CAST(month(max_date) AS INTEGER) AS max_month, CAST(quarter(max_date) AS INTEGER) AS max_quarter,
         {_trailing_sql()}
  FROM dated WINDOW {_windows_sql()}
)""",
    ) + (_report_sql("mart", key) if key else _rows_sql("mart"))


def _retail_sql(attribute: str, key: str | None) -> str:
    return sql.with_(
        sql.ITEMS,
        sql.RETAIL_CALENDAR,
        "day_items AS (SELECT items.*, retail_month_for_trailing AS trailing_month FROM items "
        "LEFT JOIN retail_days ON order_date = cal_day)",
        sql.dense("trailing_month", "day_items", True, False, attribute=attribute),
        _PRICED_UNITS,
        """dated AS (
  SELECT m.*, retail_month_start AS month_start, retail_month_end AS month_end, retail_month_number AS month,
         retail_quarter_start AS quarter_start, retail_quarter_end AS quarter_end, retail_quarter_rank AS quarter,
         retail_year_start AS year_start, retail_year_end AS year_end, retail_year AS year,
         max(retail_month_number) OVER () AS max_month, max(retail_quarter_rank) OVER () AS max_quarter,
         max(date) OVER () AS max_date
  FROM measured m LEFT JOIN retail_months ON date = retail_month_for_trailing
)""",
        f"mart AS (SELECT *, {_trailing_sql()} FROM dated WINDOW {_windows_sql()})",
    ) + (_report_sql("mart", key) if key else _rows_sql("mart"))


_OLD = sql.with_(sql.ITEMS, sql.dense("month", "items", False, False))

_DENSE = _OLD + """SELECT date AS trunc_day, parent_brand, merchant, major_cat, count(*) AS n_rows,
       CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(sample_size) AS BIGINT) AS sample_size,
       CAST(sum(iso) AS DOUBLE) AS item_subtotal_observed, CAST(sum(iqo) AS DOUBLE) AS item_quantity_observed
FROM dense GROUP BY ALL"""

# First day and length in months of a displayed period, and the months before it that it also covers.
_PERIODS = {"Monthly": ("month", 1, 0), "Quarterly": ("quarter", 3, 0), "Year-to-Date": ("year", None, 0), "Trailing 12 Months": ("month", 1, 11)}


def _view_ctes(v: view.ShareView) -> str:
    """Amounts per period and category, and the categories whose mean sample carries a line of their own."""
    grain, _, reach = _PERIODS[v.interval]
    wanted = [f"{c} IN ({', '.join(repr(x) for x in xs)})" for c, xs in v.choices.items() if xs]
    months = f"month(date) <= {v.ytd_max_month}" if v.interval == "Year-to-Date" else "TRUE"
    return _OLD + f""", amounts AS (
  SELECT date, {view.LEVELS[v.level]} AS cat, sum(gmv) AS gmv, sum(sample_size) AS sample_size, sum(iso) AS iso, sum(iqo) AS iqo
  FROM dense WHERE {" AND ".join(wanted) or "TRUE"} GROUP BY ALL
), largest AS (
  SELECT cat FROM amounts WHERE cat IS NOT NULL GROUP BY cat ORDER BY sum(gmv) DESC, cat LIMIT {v.top}
), cells AS (
  SELECT CAST(date_trunc('{grain}', date) AS DATE) AS opens,
         CASE WHEN cat IN (FROM largest) THEN cat ELSE 'Other Categories' END AS name, * EXCLUDE (date, cat)
  FROM amounts WHERE {months}
), sampled AS (
  SELECT opens, name, sum(sample_size) AS sample_size FROM cells GROUP BY ALL
), covered AS (
  SELECT own.opens, own.name, sum(past.sample_size) AS sample_size
  FROM sampled own JOIN sampled past
    ON past.name = own.name AND past.opens BETWEEN own.opens - INTERVAL {reach} MONTH AND own.opens
  GROUP BY own.opens, own.name HAVING count(*) = {reach + 1}
), carried AS (
  SELECT name, CAST(sum(sample_size) AS DOUBLE) / count(*) AS mean_sample FROM covered GROUP BY name
)"""


def _view_sql(v: view.ShareView) -> str:
    _, length, reach = _PERIODS[v.interval]
    length = length or v.ytd_max_month or 1
    metric = {"GMV": "gmv", "Units": "units"}[v.metric] + ("_perc" if v.as_share else "")
    digits = 6 if v.as_share else 4
    few = [xs for xs in (v.choices.get(c) for c in ("minor_cat", "sub_cat", "major_cat")) if xs and len(xs) <= 2]
    text = ", ".join(few[0]) if few else "Multiple Categories"
    return _view_ctes(v) + f""", lines AS (
  SELECT opens, CASE WHEN name IN (SELECT name FROM carried WHERE mean_sample >= {v.min_sample}) THEN name
                     ELSE 'Other Categories' END AS line,
         sum(gmv) AS gmv, sum(sample_size) AS sample_size, {sql.ratio('sum(iso)', 'sum(iqo)')} AS asp
  FROM cells GROUP BY ALL
), priced AS (
  SELECT *, CAST(CAST(gmv AS DOUBLE) / nullif(asp, 0) AS DECIMAL(36,8)) AS units FROM lines
), periods AS (
  SELECT own.opens AS display_time, own.line AS display_cat, own.asp, sum(past.gmv) AS gmv, sum(past.units) AS units,
         CAST(sum(past.sample_size) AS BIGINT) AS sample_size
  FROM priced own JOIN priced past
    ON past.line = own.line AND past.opens BETWEEN own.opens - INTERVAL {reach} MONTH AND own.opens
  GROUP BY ALL HAVING count(*) = {reach + 1}
), totals AS (
  SELECT display_time, sum(gmv) AS all_gmv, sum(units) AS all_units FROM periods GROUP BY display_time
), page AS (
  SELECT display_time, display_cat, CAST(gmv AS DOUBLE) AS gmv, CAST(round(units, 4) AS DOUBLE) AS units, sample_size, asp,
         {sql.ratio('gmv', 'all_gmv')} AS gmv_perc, round({sql.ratio('units', 'all_units')}, 6) AS units_perc
  FROM periods JOIN totals USING (display_time)
)
SELECT *, '{text}' AS category_texts, round({metric}, {digits}) AS display_metric,
       CAST(display_time - INTERVAL {reach} MONTH AS DATE) AS period_starting,
       CAST(display_time + INTERVAL {length} MONTH AS DATE) - 1 AS period_end
FROM page"""


_INTERVAL_SQL = """
WITH months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m
                FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
shown AS (
""" + "\n  UNION ALL ".join(
    f"SELECT '{i}' AS display_interval, CAST(date_trunc('{g}', m) AS DATE) AS display_time FROM months"
    for i, g in zip(DISPLAY_INTERVALS, ("year", "quarter", "month", "year", "month", "month", "month"))
) + """)
SELECT display_interval, count(DISTINCT display_time) AS periods, min(display_time) AS first_period,
       max(display_time) AS last_period
FROM shown GROUP BY display_interval"""

ORACLE = {
    "market_share_std": _standard_sql("major_cat", "brand"),
    "market_share_454": _retail_sql("major_cat", "brand"),
    "market_share_rows": _standard_sql("major_cat", None),
    "market_share_rows_454": _retail_sql("major_cat", None),
    "market_share_attribute": _standard_sql("finish", "special_attribute"),
    "market_share_attribute_454": _retail_sql("finish", "special_attribute"),
    "market_share_dense": _DENSE,
    "display_intervals": _INTERVAL_SQL,
    **{name: _view_sql(v) for name, v in VIEWS.items()},
    "guardrail": _view_ctes(VIEWS["share_display_month"])
    + f" SELECT name AS display_cat, mean_sample AS breakdown_ssg, mean_sample >= {VIEWS['share_display_month'].min_sample} AS is_over_threshold FROM carried",
    "risk_message": f"WITH page AS ({_view_sql(VIEWS['share_display_month'])}) "
    "SELECT CASE WHEN min(sample_size) < 200 OR count(*) FILTER (WHERE display_cat = 'Other Categories') > 0 "
    "THEN 'The sample behind part of this view is thin, so some categories are pooled. A longer period or fewer filters show more.' "
    "ELSE ' ' END AS risk_message FROM page",
    "trailing_gaps": sql.with_(
        sql.ITEMS,
        "series AS (SELECT month, channel, brand, merchant_clean, major_cat, sum(gmv) AS gmv FROM items GROUP BY ALL)",
        """windowed AS (SELECT *, CAST(sum(month(month)) OVER (PARTITION BY channel, brand, merchant_clean, major_cat
         ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS partition_factor FROM series)""",
    )
    + "SELECT month, channel, brand, merchant_clean, major_cat, CAST(gmv AS DOUBLE) AS gmv, partition_factor "
    "FROM windowed WHERE partition_factor < 78",
}
