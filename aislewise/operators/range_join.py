"""Joining points with intervals of any length, open ends included, without a row per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Levels of a 64-bit axis: bins of level n are 2^n wide.
LEVELS = 64
# A join uses every fourth level: a quarter of the lookups of each point, for about 2.5 times the tests of a pair that is met.
STEP = 4


def _ordinal(df: DataFrame, column: str) -> Column:
    """The value as a whole number: days, microseconds or the number itself."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        # Clock times are taken apart: as instants of a session's zone, those of a repeated hour would be the same.
        seconds = F.hour(column) * 3600 + F.minute(column) * 60 + F.date_part(F.lit("SECOND"), F.col(column))
        return F.unix_date(F.col(column).cast("date")).cast("bigint") * 86_400_000_000 + (seconds * 1_000_000).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    raise TypeError(f"{column}: {kind.simpleString()} is neither a date, a timestamp nor a whole number")


def _same_type(rows: DataFrame, intervals: DataFrame, point: str, ends: Sequence[str]) -> None:
    kind = rows.schema[point].dataType
    for c in ends:
        other = intervals.schema[c].dataType
        if other != kind and not (isinstance(other, T.IntegralType) and isinstance(kind, T.IntegralType)):
            raise TypeError(f"{c} is {other.simpleString()}, but {point} is {kind.simpleString()}")


def binned(intervals: DataFrame, first: Column, last: Column, lowest: Column, highest: Column, step: int = 1) -> DataFrame:
    """Intervals clipped to the axis that has points, each under the one or two bins that cover it.

    An interval goes to the level whose bins are the first that are wider than it, so it meets at most two of them and
    fills at least a quarter of what they cover: a point that meets it in a bin is inside it often. An end that is NULL is open.
    With ``step`` only levels divisible by it are used, up to the highest of all.
    """
    clipped = intervals.withColumns({"__lowest": lowest, "__highest": highest})
    clipped = clipped.withColumns(
        {
            "__from": F.greatest(F.coalesce(first, F.col("__lowest")), F.col("__lowest")),
            "__to": F.least(F.coalesce(last, F.col("__highest")), F.col("__highest")),
        }
    ).filter(F.col("__from") <= F.col("__to"))
    # The number of binary digits of the length; a length beyond 64 bits has no difference.
    length = F.try_subtract(F.col("__to"), F.col("__from"))
    digits = F.when(length == 0, 0).otherwise(F.length(F.bin(length)))
    level = F.least(F.ceil(F.coalesce(digits, F.lit(LEVELS - 1)) / step) * step, F.lit(LEVELS - 1))
    levelled = clipped.withColumn("__level", level.cast("int"))
    bins = F.array_distinct(F.array(F.expr("shiftright(__from, __level)"), F.expr("shiftright(__to, __level)")))
    return levelled.withColumn("__bin", F.explode(bins)).drop("__lowest", "__highest")


def lookups(points: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points repeated under their bin of each level in use, where there are keys only of the levels their key uses."""
    # At most LEVELS numbers, whatever the number of intervals.
    used = F.collect_set("__level")
    if keys:
        levelled = points.join(placed.groupBy(*keys).agg(used.alias("__levels")), list(keys))
    else:
        levelled = points.withColumn("__levels", placed.agg(F.array_sort(used)).scalar())
    spread = levelled.select("*", F.explode("__levels").alias("__level")).drop("__levels")
    return spread.withColumn("__bin", F.expr("shiftright(__at, __level)"))


def range_join(
    rows: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[str] = (), how: str = "left"
) -> DataFrame:
    """Join on ``point BETWEEN start AND end`` (both included) and on equal ``on`` columns.

    Dates, timestamps and whole numbers, down to a microsecond. An end that is NULL is open; an interval that ends before
    it starts holds nothing; a point that is NULL, or an ``on`` column that is NULL, matches nothing. Overlapping
    intervals match more than once. Rows that repeat are kept as often; ``how`` is ``left`` or ``inner``.

    Intervals are kept under one or two bins of a level that fits their length, points are looked up once on each level
    in use (by their key, if there are keys), and a test of the bounds follows: an equi join on (keys, level, bin).
    An inner join looks up the rows themselves, and no pair is moved after it is found. A left join looks up the different
    points and joins what they meet back to the rows, which keeps rows that meet nothing. Neither the rows of
    an interval nor its length multiply anything.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    _same_type(rows, intervals, point, (start, end))
    keys = list(on)
    clash = (set(rows.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    points = rows.dropna(subset=[*keys, point]) if how == "inner" else rows.select(*keys, point).dropna().distinct()
    points = points.withColumn("__at", _ordinal(rows, point))
    bounds = rows.agg(F.struct(F.min(_ordinal(rows, point)).alias("low"), F.max(_ordinal(rows, point)).alias("high"))).scalar()
    kept = intervals.dropna(subset=keys) if keys else intervals
    placed = binned(kept, _ordinal(intervals, start), _ordinal(intervals, end), bounds["low"], bounds["high"], STEP)
    spread = lookups(points, placed, keys)
    met = spread.join(placed, [*keys, "__level", "__bin"]).filter(F.col("__at").between(F.col("__from"), F.col("__to")))
    if how == "inner":
        return met.select(*rows.columns, *[c for c in intervals.columns if c not in keys])
    found = met.select(*[F.col(c).alias(f"__{c}") for c in (*keys, point)], *[c for c in intervals.columns if c not in keys])
    test = F.col(point) == F.col(f"__{point}")
    for k in keys:
        test = test & (F.col(k) == F.col(f"__{k}"))
    return rows.join(found, test, how).drop(*[f"__{c}" for c in (*keys, point)])
