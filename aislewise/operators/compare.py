"""Comparing two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.functions.measures import ratio

ONLY_FIRST, ONLY_SECOND = "only_first", "only_second"


def _signed(df: DataFrame, columns: Sequence[str], sign: int) -> DataFrame:
    return df.select(*columns).withColumn("__sign", F.lit(sign).cast("bigint"))


def multiset_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with ``side`` and the number of surplus copies.

    One aggregate over both tables: surplus copies are counted instead of written out, so a row repeated
    a billion times is one output row and is summed before the shuffle.
    """
    columns = sorted(set(first.columns) & set(second.columns))
    both = _signed(first, columns, 1).unionByName(_signed(second, columns, -1))
    surplus = both.groupBy(*columns).agg(F.sum("__sign").alias("surplus")).filter(F.col("surplus") != 0)
    return surplus.withColumns(
        {
            "side": F.when(F.col("surplus") > 0, ONLY_FIRST).otherwise(ONLY_SECOND),
            "surplus": F.abs("surplus"),
        }
    )


def except_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` missing from ``second``, copies counted, as Spark's own multiset difference."""
    columns = sorted(set(first.columns) & set(second.columns))
    return first.select(*columns).exceptAll(second.select(*columns))


def column_differences(first: DataFrame, second: DataFrame) -> list[tuple[str, str, str]]:
    """Columns missing on one side or typed differently, as (column, first type, second type)."""
    a = {f.name: f.dataType.simpleString() for f in first.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in second.schema.fields}
    return [(c, a.get(c, "missing"), b.get(c, "missing")) for c in sorted({*a, *b}) if a.get(c) != b.get(c)]


def compare_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: schema match, row counts, surplus rows on each side, and the overall verdict."""
    differences = column_differences(first, second)
    common = sorted(set(first.columns) & set(second.columns))
    both = _signed(first, common, 1).unionByName(_signed(second, common, -1))
    grouped = both.groupBy(*common).agg(
        F.sum("__sign").alias("__surplus"),
        F.count_if(F.col("__sign") > 0).alias("__first"),
        F.count_if(F.col("__sign") < 0).alias("__second"),
    )
    zero = F.lit(0).cast("bigint")
    counts = grouped.agg(
        F.coalesce(F.sum("__first"), zero).alias("rows_first"),
        F.coalesce(F.sum("__second"), zero).alias("rows_second"),
        F.coalesce(F.sum(F.greatest("__surplus", zero)), zero).alias(ONLY_FIRST),
        F.coalesce(F.sum(F.greatest(-F.col("__surplus"), zero)), zero).alias(ONLY_SECOND),
    )
    content = (F.col(ONLY_FIRST) == 0) & (F.col(ONLY_SECOND) == 0)
    return counts.withColumns(
        {
            "schema_match": F.lit(not differences),
            "row_count_match": F.col("rows_first") == F.col("rows_second"),
            "content_match": content,
            "identical": content & F.lit(not differences),
        }
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sum, average, smallest, largest and standard deviation of every numeric column, one row each.

    All columns share one scan; the single result row is then turned on its side.
    """
    columns = list(columns or numeric_columns(df))
    aggregates = []
    for c in columns:
        value = F.col(c)
        aggregates += [
            F.sum(value).cast("double").alias(f"{c}|sum"),
            ratio(F.sum(value), F.count(value)).alias(f"{c}|avg"),
            F.min(value).cast("double").alias(f"{c}|min"),
            F.max(value).cast("double").alias(f"{c}|max"),
            F.stddev(value.cast("double")).alias(f"{c}|stddev"),
        ]
    wide = df.agg(*aggregates)
    stats = ("sum", "avg", "min", "max", "stddev")
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def compare_stats(first: DataFrame, second: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics of both tables next to each other with one verdict per column."""
    columns = list(columns or [c for c in numeric_columns(first) if c in numeric_columns(second)])
    stats = ("sum", "avg", "min", "max", "stddev")
    a = numeric_stats(first, columns)
    b = numeric_stats(second, columns).withColumnsRenamed({s: f"{s}_second" for s in stats})
    joined = a.join(b, "column")
    same = F.lit(True)
    for s in stats:
        same = same & F.col(s).eqNullSafe(F.col(f"{s}_second"))
    return joined.withColumn("stats_match", same)


def side_by_side(
    first: DataFrame, second: DataFrame, keys: Sequence[str], date: str, names: tuple[str, str] = ("first", "second")
) -> DataFrame:
    """Full outer join of the distinct dates of two marts with the difference in days."""
    a = first.select(*keys, F.col(date).alias(f"{names[0]}_date")).distinct()
    b = second.select(*keys, F.col(date).alias(f"{names[1]}_date")).distinct()
    return a.join(b, list(keys), "full_outer").withColumn(
        "date_difference_days", F.datediff(f"{names[0]}_date", f"{names[1]}_date")
    )
