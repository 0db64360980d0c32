"""Data-quality checks. Each returns rows (check, column, value, status) from as few scans as possible."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the checks look at unless told otherwise, and the bounds they apply (fixed values).
CRITICAL = ("order_date", "brand", "merchant", "item_price", "item_quantity", "gmv", "user_id")
MONETARY = ("item_price", "gmv", "full_price_estimate")
QUANTITIES = ("item_quantity",)
DATES = ("order_date", "panel_end_date", "panel_start_date", "cohort_date")
NON_EMPTY = ("brand", "merchant", "user_id", "order_id", "product_id")
IDENTIFIERS = ("order_id", "user_id", "row_id")
MAX_PRICE = 50000.0
EARLIEST = dt.date(2015, 1, 1)

# Date spellings that are recognised, tried in this order (fixed values).
DATE_FORMATS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$"),
    ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}$"),
    ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$"),
    ("YYYY-MM-DD HH:MM:SS", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("ISO 8601", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
)


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _sideways(df: DataFrame, columns: Sequence[str], measures: Mapping[str, object]) -> DataFrame:
    """One aggregate with every measure of every column, returned as one row per column."""
    aggregates = [fn(F.col(c)).alias(f"{c}|{m}") for c in columns for m, fn in measures.items()]
    wide = df.agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{m}`").alias(m) for m in measures]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def _status(bad: Column, label: str = "FAILED") -> Column:
    return F.when(bad, label).otherwise("PASSED")


def null_check(df: DataFrame, columns: Sequence[str] = CRITICAL) -> DataFrame:
    """Missing values in columns that must be filled."""
    found = _sideways(
        df,
        _present(df, columns),
        {"null_count": lambda c: F.count_if(c.isNull()), "total_rows": lambda c: F.count(F.lit(1))},
    )
    share = F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("total_rows")), F.lit(0.0))
    return found.withColumns({"null_percentage": share, "status": _status(F.col("null_count") > 0)})


def negative_check(df: DataFrame, columns: Sequence[str] = (*MONETARY, *QUANTITIES), max_price: float = MAX_PRICE) -> DataFrame:
    """Negative amounts, with the range of each column and a flag for implausibly large ones."""
    found = _sideways(
        df,
        _present(df, columns),
        {
            "negative_count": lambda c: F.count_if(c < 0),
            "min_value": lambda c: F.min(c).cast("double"),
            "max_value": lambda c: F.max(c).cast("double"),
            "sum_value": lambda c: F.sum(c).cast("double"),
            "non_null_count": F.count,
        },
    )
    high = F.col("column").isin("item_price", "gmv") & (F.col("max_value") > max_price)
    return found.withColumns(
        {
            "avg_value": F.try_divide(F.col("sum_value"), F.col("non_null_count").cast("double")),
            "status": _status(F.col("negative_count") > 0),
            "high_value_warning": F.coalesce(high, F.lit(False)),
        }
    ).drop("sum_value")


def date_check(
    df: DataFrame, columns: Sequence[str] = DATES, earliest: dt.date = EARLIEST, latest: dt.date | None = None
) -> DataFrame:
    """Dates before ``earliest`` or after ``latest`` (tomorrow when not given)."""
    latest = latest or dt.date.today() + dt.timedelta(days=1)
    found = _sideways(
        df,
        _present(df, columns),
        {
            "too_old_count": lambda c: F.count_if(c.cast("date") < F.lit(earliest)),
            "too_new_count": lambda c: F.count_if(c.cast("date") > F.lit(latest)),
            "min_date": lambda c: F.min(c.cast("date")),
            "max_date": lambda c: F.max(c.cast("date")),
            "non_null_count": F.count,
        },
    )
    invalid = F.col("too_old_count") + F.col("too_new_count")
    return found.withColumns({"total_invalid": invalid, "status": _status(invalid > 0)})


def blank_check(df: DataFrame, columns: Sequence[str] = NON_EMPTY) -> DataFrame:
    """Empty and whitespace-only texts. An empty text counts on both sides, as the trimmed test sees it too."""
    found = _sideways(
        df,
        _present(df, columns),
        {
            "empty_count": lambda c: F.count_if(c.cast("string") == ""),
            "whitespace_count": lambda c: F.count_if(F.trim(c.cast("string")) == ""),
            "null_count": lambda c: F.count_if(c.isNull()),
            "non_null_count": F.count,
        },
    )
    bad = F.col("empty_count") + F.col("whitespace_count")
    return found.withColumns({"total_empty_like": bad, "status": _status(bad > 0)})


def duplicate_check(df: DataFrame, identifiers: Sequence[str] = IDENTIFIERS, tolerance: float = 0.01) -> DataFrame:
    """Repeated whole rows and repeated identifiers, from one scan.

    Any repeat of ``order_id`` is a warning, other identifiers are allowed ``tolerance``. Whole rows are
    compared by two independent hashes and their pattern of missing values, so wide rows are not shuffled.
    """
    values = [
        F.to_json(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f.name) for f in df.schema.fields
    ]
    missing = F.concat(*[v.isNull().cast("int").cast("string") for v in values])
    row = F.struct(F.xxhash64(*values, missing), F.hash(*values, missing))
    ids = _present(df, identifiers)
    found = _sideways(
        df.select(row.alias("complete_row"), *ids),
        ["complete_row", *ids],
        {"non_null_count": F.count, "distinct_count": F.count_distinct},
    )
    repeats = F.col("non_null_count") - F.col("distinct_count")
    strict = F.col("column").isin("complete_row", "order_id")
    bad = (strict & (repeats > 0)) | (repeats > F.col("non_null_count") * tolerance)
    return found.withColumns(
        {
            "duplicate_count": repeats,
            "duplicate_percentage": F.coalesce(F.try_divide(repeats * 100.0, F.col("non_null_count")), F.lit(0.0)),
            "status": _status(bad, "WARNING"),
        }
    )


def date_format_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many texts of each column follow each date spelling, over all rows rather than a sample."""
    def spelled(i: int):
        _, pattern = DATE_FORMATS[i]
        earlier = [p for _, p in DATE_FORMATS[:i]]

        def measure(c: Column) -> Column:
            hit = c.rlike(pattern)
            for p in earlier:
                hit = hit & ~c.rlike(p)
            return F.count_if(hit)

        return measure

    names = [f"format_{i + 1}" for i in range(len(DATE_FORMATS))]
    measures = {n: spelled(i) for i, n in enumerate(names)}
    measures["total_values"] = lambda c: F.count_if(c.isNotNull() & (c != ""))
    found = _sideways(df, _present(df, columns), measures)
    known = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    kinds = sum(((F.col(n) > 0).cast("int") for n in names[1:]), (F.col(names[0]) > 0).cast("int"))
    spelling = F.array_compact(F.array(*[F.when(F.col(n) > 0, label) for n, (label, _) in zip(names, DATE_FORMATS)]))
    return found.select(
        "column",
        "total_values",
        F.array_join(spelling, ", ").alias("formats_found"),
        kinds.alias("format_count"),
        (F.col("total_values") - known).alias("invalid_format_count"),
        (kinds > 1).alias("has_mixed_formats"),
        _status((kinds > 1) | (F.col("total_values") > known)).alias("status"),
    )


def nonnull_profile(df: DataFrame, exclude: Sequence[str] = (), fraction: float | None = None) -> DataFrame:
    """Non-null count per column from one scan, optionally of a sample.

    A sampled profile may miss columns that are almost always NULL.
    """
    columns = [c for c in df.columns if c not in exclude]
    scanned = df if fraction is None else df.sample(fraction=fraction, seed=7)
    return _sideways(scanned, columns, {"non_null_count": F.count})


def live_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The columns that hold at least one value, excluded ones left out. Looks at one row of counts."""
    columns = [c for c in df.columns if c not in exclude]
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.select(*[c for c in columns if counts[c] > 0])


def standardize_attributes(df: DataFrame, columns: Sequence[str] | None, replacement: str = "N/A") -> DataFrame:
    """Replace missing attribute values in one projection; unknown columns are skipped."""
    known = _present(df, columns or ())
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(replacement)) for c in known})


def validate_attributes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PASS, FAIL or MISSING per attribute column, from one scan."""
    known = _present(df, columns)
    measures = {"null_count": lambda c: F.count_if(c.isNull()), "total_count": lambda c: F.count(F.lit(1))}
    missing = [c for c in columns if c not in known]
    found = None
    if known:
        found = _sideways(df, known, measures).withColumn(
            "status", F.when(F.col("null_count") > 0, "FAIL").otherwise("PASS")
        )
    if missing:
        rows = [(c, None, None, "MISSING") for c in missing]
        absent = df.sparkSession.createDataFrame(rows, "column string, null_count bigint, total_count bigint, status string")
        found = absent if found is None else found.unionByName(absent)
    return found


def attribute_fill(tagged: DataFrame, group: str, attribute: str, marker: str = "major_cat") -> DataFrame:
    """Per table of a tagged union: fill rate of the attribute text and how often it carries ``marker``."""
    found = tagged.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(attribute).alias("non_null_count"),
        F.count_if(F.col(attribute).contains(marker)).alias("marked_count"),
    )
    return found.withColumns(
        {
            "null_count": F.col("total_records") - F.col("non_null_count"),
            "fill_rate": F.try_divide(F.col("non_null_count") * 100.0, F.col("total_records")),
            "marked_percentage": F.coalesce(
                F.try_divide(F.col("marked_count") * 100.0, F.col("non_null_count")), F.lit(0.0)
            ),
        }
    )


def attribute_validity(frames: Mapping[str, DataFrame | None], column: str) -> DataFrame:
    """``(table_name, rows, filled, verdict)``: whether each table carries ``column`` as a filled variant.

    A frame of None stands for a table that does not exist. Types are looked up in the schemas; each table
    is read once for its two counts. The verdict names the first thing that is amiss: ``no table``,
    ``no column``, ``other type``, ``empty``, else ``usable``.
    """
    spark = next(df for df in frames.values() if df is not None).sparkSession
    found = spark.createDataFrame([(n, None, None, "no table") for n, df in frames.items() if df is None], _VALIDITY)
    for name, df in frames.items():
        if df is None:
            continue
        filled = F.count(column) if column in df.columns else F.lit(None).cast("bigint")
        variant = column in df.columns and df.schema[column].dataType.typeName() == "variant"
        verdict = F.when(F.col("filled") > 0, "usable").otherwise("empty") if variant else F.lit("other type" if column in df.columns else "no column")
        counts = df.agg(F.count(F.lit(1)).alias("rows"), filled.alias("filled"))
        found = found.unionByName(counts.select(F.lit(name).alias("table_name"), "rows", "filled", verdict.alias("verdict")))
    return found


_VALIDITY = "table_name string, rows bigint, filled bigint, verdict string"


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values with their share of the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(column)).scalar()
    return (
        counts.orderBy(F.desc("count"), F.asc(column))
        .limit(n)
        .withColumn("percentage", F.round(F.try_divide(F.col("count") * 100.0, total), 2))
    )


def freshness(tagged: DataFrame, expected: DataFrame, table: str = "table_name", day: str = "order_date") -> DataFrame:
    """Newest date per table against the expected one.

    ``tagged`` holds the dates of all tables under their name, ``expected`` one row per table that should
    exist with its ``expected_date``.
    """
    newest = tagged.groupBy(table).agg(F.max(day).alias("max_date"))
    status = (
        F.when(F.col("max_date").isNull(), "TABLE_NOT_FOUND")
        .when(F.col("max_date") == F.col("expected_date"), "OK")
        .otherwise(F.concat(F.lit("WRONG_DATE (expected: "), F.col("expected_date").cast("string"), F.lit(")")))
    )
    return expected.join(newest, table, "left").withColumn("status", status)


def freshness_profile(tagged: DataFrame, table: str = "table_name", stamp: str = "_updated_timestamp") -> DataFrame:
    """First and last update stamp per table and how many different stamps it holds."""
    return tagged.groupBy(table).agg(
        F.min(stamp).alias("first_update"),
        F.max(stamp).alias("last_update"),
        F.count_distinct(stamp).alias("unique_timestamps"),
    )


def calendar_check(days: DataFrame) -> DataFrame:
    """Days and trailing months of each 4-5-4 month; more than one trailing month is an inconsistency."""
    found = days.groupBy("retail_month_start").agg(
        F.count_distinct("retail_month_for_trailing").alias("trailing_months"),
        F.min("cal_day").alias("first_day"),
        F.max("cal_day").alias("last_day"),
        F.count_distinct("cal_day").alias("days_in_month"),
    )
    return found.withColumn("calendar_issue", F.col("trailing_months") > 1)


def brand_ready(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Gmv of the parent brand each client shows on its cover page.

    A missing parent brand falls back to the brand. Clients without a sale of their brand are not ready.
    """
    parent = F.coalesce("parent_brand", "brand") if "parent_brand" in items.columns else F.col("brand")
    sold = items.groupBy(parent.alias("parent_brand")).agg(F.sum("gmv").alias("gmv"))
    return expected.join(sold, "parent_brand", "left").withColumn("is_ready", F.col("gmv").isNotNull())
