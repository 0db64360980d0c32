"""Gap filling and trailing sums of monthly series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.functions.periods import FACTOR_TOTAL, month_factor

_MONTH = "interval 1 month"


def fill_months(
    series: DataFrame,
    keys: Sequence[str],
    month: str,
    metrics: Sequence[str],
    last_month: Column,
    first_month: dt.date | None = None,
    margin: int = 12,
    blank: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Give every key one row per month with 0 for months it lacks.

    A series reaches ``margin`` months before its first row, not before ``first_month``, and ``margin``
    months after its last row, not beyond ``last_month``. ``series`` must hold one row per key and month.
    Columns in ``blank`` are NULL in added months; columns in ``carry``, such as running totals, keep the
    value of the last row and are 0 before the first.

    Each row covers the months from itself up to the next row of its key; the first row also covers the
    lead-in and the last row the tail. That needs one shuffle on the keys and no calendar join, treats
    NULL keys as a group of their own, and leaves the data partitioned for :func:`trailing_sums`.
    """
    by_key = Window.partitionBy(*keys).orderBy(month)
    here = F.col(month)
    lead_in = F.add_months(here, -margin)
    if first_month is not None:
        lead_in = F.greatest(lead_in, F.lit(first_month))
    start = F.when(F.lag(month).over(by_key).isNull(), lead_in).otherwise(here)
    following = F.lead(month).over(by_key)
    tail = F.least(F.add_months(here, margin), last_month)
    end = F.when(following.isNull(), tail).otherwise(F.add_months(following, -1))
    kept = series.filter(here.isNotNull())
    if first_month is not None:
        kept = kept.filter(here >= F.lit(first_month))
    covered = kept.withColumns({"__from": start, "__to": end})
    opened = covered.withColumn("__month", F.explode(F.sequence("__from", "__to", F.expr(_MONTH))))
    real = F.col("__month") == here
    zero_filled = [F.when(real, F.col(m)).otherwise(F.lit(0)).cast(opened.schema[m].dataType).alias(m) for m in metrics]
    null_filled = [F.when(real, F.col(c)).alias(c) for c in blank]
    before = F.col("__month") < here
    carried = [F.when(before, F.lit(0)).otherwise(F.col(c)).cast(opened.schema[c].dataType).alias(c) for c in carry]
    return opened.select(F.col("__month").alias(month), *keys, *zero_filled, *null_filled, *carried)


def _subtractable(total: Column, series: DataFrame, name: str) -> Column:
    """One digit below the widest decimal, so that a difference of two totals keeps its scale."""
    kind = series.schema[name].dataType
    return total.cast(f"decimal(37,{kind.scale})") if isinstance(kind, T.DecimalType) else total


def running_totals(
    series: DataFrame, keys: Sequence[str], month: str, metrics: Sequence[str], may_be_null: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Add the running total of each metric, and its running count where it may be NULL.

    Also returns the names of the added columns, which :func:`fill_months` can carry into added months:
    totals are then summed over the observed rows only, before the gaps are filled.
    """
    so_far = Window.partitionBy(*keys).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    running = {f"__sum_{m}": _subtractable(F.sum(m).over(so_far), series, m) for m in metrics}
    running |= {f"__count_{m}": F.count(m).over(so_far) for m in may_be_null}
    return series.withColumns(running), list(running)


def trailing_from_totals(
    totals: DataFrame,
    keys: Sequence[str],
    month: str,
    metrics: Sequence[str],
    spans: Sequence[int] = (12, 6, 3),
    may_be_null: Sequence[str] = (),
) -> DataFrame:
    """Trailing sums of a series with running totals: the total now minus the total ``span`` rows earlier.

    A window counts only when its rows are consecutive months. A metric in ``may_be_null`` stays NULL over
    a window without any value.
    """
    by_key = Window.partitionBy(*keys).orderBy(month)
    running = [f"__sum_{m}" for m in metrics] + [f"__count_{m}" for m in may_be_null]
    earlier = {}
    for span in spans:
        for c in running:
            nothing = F.lit(0).cast(totals.schema[c].dataType)
            earlier[f"{c}_{span}"] = F.coalesce(F.lag(c, span).over(by_key), nothing)
        earlier[f"__first_{span}"] = F.lag(month, span - 1).over(by_key)
    both = totals.withColumns(earlier)
    trailing = {}
    for span in spans:
        full = F.col(f"__first_{span}") == F.add_months(month, 1 - span)
        for m in metrics:
            shown = full & (F.col(f"__count_{m}") > F.col(f"__count_{m}_{span}")) if m in may_be_null else full
            difference = F.coalesce(F.col(f"__sum_{m}"), F.lit(0)) - F.col(f"__sum_{m}_{span}")
            trailing[f"{m}_trailing_{span}m"] = F.when(shown, difference)
    return both.withColumns(trailing).drop(*running, *earlier)


def trailing_sums(
    series: DataFrame,
    keys: Sequence[str],
    month: str,
    metrics: Sequence[str],
    spans: Sequence[int] = (12, 6, 3),
    may_be_null: Sequence[str] = (),
) -> DataFrame:
    """Sums over the last 12, 6 and 3 rows, kept only where the rows are consecutive months.

    Running totals cost one addition per row, where a sliding frame adds ``span`` rows again for each row.
    All windows share one definition, so the data is shuffled and sorted once.
    """
    totals, _ = running_totals(series, keys, month, metrics, may_be_null)
    return trailing_from_totals(totals, keys, month, metrics, spans, may_be_null)


def trailing_gaps(series: DataFrame, keys: Sequence[str], month: str, since=None, span: int = 12) -> DataFrame:
    """Rows whose trailing window is not ``span`` consecutive months, with the factor found."""
    rows = Window.partitionBy(*keys).orderBy(month).rowsBetween(1 - span, 0)
    factor = F.sum(month_factor(span, F.col(month))).over(rows)
    checked = series.withColumn("partition_factor", factor).filter(F.col("partition_factor") < FACTOR_TOTAL[span])
    return checked if since is None else checked.filter(F.col(month) >= F.lit(since))
