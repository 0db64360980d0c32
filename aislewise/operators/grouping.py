"""Grouping operators shared by the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM_METRICS = ("gmv", "sample_size", "item_subtotal_observed", "item_quantity_observed")


def hier_agg(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Item metrics per key: gmv, rows, observed spend and observed quantity."""
    return items.groupBy(*keys).agg(
        F.sum("gmv").alias("gmv"),
        F.count(F.lit(1)).alias("sample_size"),
        F.sum(F.col("item_price") * F.col("item_quantity")).alias("item_subtotal_observed"),
        F.sum("item_quantity").alias("item_quantity_observed"),
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join where NULL keys match each other and NULL differs from the empty text."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    matched = left
    test = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        test = part if test is None else test & part
    return matched.join(renamed, test, how).drop(*[f"__{k}" for k in keys])


def scalar(df: DataFrame, value: Column) -> Column:
    """A whole-table aggregate as a scalar subquery: one row, no window over one partition."""
    return df.agg(value).scalar()


def largest(df: DataFrame, column: str) -> Column:
    """Largest value of a column of a shuffled aggregate, as a scalar subquery that shares its shuffle.

    A plain ``max`` would prune the other columns away, giving a different shuffle and a second pass over
    the raw rows. Comparing whole rows, the wanted column first, keeps the aggregate as the query has it.
    """
    rest = [c for c in df.columns if c != column]
    return df.agg(F.max(F.struct(column, *rest))[column]).scalar()


def with_group_totals(df: DataFrame, value: str, totals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Attach the sum of ``value`` over each column set in ``totals``.

    Aggregates joined back, not windows: partial sums shrink a hot group before it is shuffled, and the
    join may broadcast the small side or split the hot key, while a window would put the whole group into
    one task. The table is summed once, to all the columns involved, and every total is taken from that.
    """
    finest = list(dict.fromkeys(c for keys in totals.values() for c in keys))
    sums = df.groupBy(*finest).agg(F.sum(value).alias("__value"))
    for name, keys in totals.items():
        df = null_safe_join(df, sums.groupBy(*keys).agg(F.sum("__value").alias(name)), list(keys))
    return df


def top_n(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest total, ties broken by name."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(value).alias("__total"))
        .orderBy(F.desc_nulls_last("__total"), F.asc(key))
        .limit(n)
        .select(key)
    )


def top_ranked(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """Keys whose total ranks at most ``n``; ties at the last place are all kept.

    The n-th largest total is found with a top-n sort, then every key at or above it is kept: the same
    rows as ``rank() <= n`` without sorting all keys in one partition.
    """
    totals = df.groupBy(key).agg(value.alias("__total")).filter(F.col("__total").isNotNull())
    cut = totals.orderBy(F.desc("__total")).limit(n).agg(F.min("__total")).scalar()
    return totals.filter(F.col("__total") >= cut).select(key)


def label_others(df: DataFrame, kept: DataFrame, key: str, other: str, bound: int | None = None) -> DataFrame:
    """Relabel ``key`` to ``other`` where it is not in ``kept``.

    ``bound`` states the most rows ``kept`` can hold; it is broadcast only then.
    """
    mark = kept.select(F.col(key).alias("__kept"))
    if bound is not None:
        mark = F.broadcast(mark)
    joined = df.join(mark, F.col(key) == F.col("__kept"), "left")
    return joined.withColumn(key, F.coalesce("__kept", F.lit(other))).drop("__kept")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest row per key as an aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, order, *tiebreak)]
    newest = F.max(F.struct(order, *tiebreak, *rest)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in df.columns if c not in keys])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest values of ``columns`` per key. Unlike :func:`latest_per_key` the values need not be orderable."""
    point = F.struct(*order)
    picked = F.max_by(F.struct(*order, *columns), point).alias("__row")
    out = [*order, *columns]
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in out])


def rows_of_top_keys(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """All rows of the ``n`` keys with the largest total."""
    return df.join(top_n(df, key, value, n), key, "left_semi")


def distinct_list(df: DataFrame, column: str, alias: str, separator: str = ", ") -> DataFrame:
    """Sorted distinct values as one text. For short lists such as the kept brands of a chart."""
    return df.agg(F.array_join(F.array_sort(F.collect_set(column)), separator).alias(alias))


def ordered_positions(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Number the distinct values of a period column from 1.

    Periods are few by nature (quarters of a panel), so one partition sorts them.
    """
    distinct = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return distinct.withColumn(alias, F.row_number().over(Window.orderBy(column)))


def last_periods(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` newest distinct periods."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(F.desc(column)).limit(n)


def rolling_periods(
    facts: DataFrame,
    periods: DataFrame,
    keys: Sequence[str],
    period: str,
    values: Mapping[str, str],
    span: int,
) -> DataFrame:
    """Rolling sums over the last ``span`` periods of ``periods`` for every key.

    The reporting grid (every key in every period) is never built. A fact row is repeated under the
    periods whose window covers it, at most ``span`` of them, and summed there; grid cells whose window
    holds no fact would be NULL and are dropped by the reports anyway. The list of periods is read once: every
    period carries the ones whose window covers it. Spark broadcasts a short period list by itself.
    """
    listed = periods.filter(F.col(period).isNotNull()).select(period).distinct()
    in_order = Window.orderBy(period)
    covering = F.array_compact(F.array(*[F.lead(period, i).over(in_order) for i in range(span)]))
    placed = facts.join(listed.select(F.col(period).alias("__own"), covering.alias("__covering")), F.col(period) == F.col("__own"))
    spread = placed.withColumn(period, F.explode("__covering"))
    return spread.groupBy(*keys, period).agg(*[F.sum(src).alias(out) for out, src in values.items()])
