"""Row numbers over a whole table and pages of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.sources.sinks import copy_files

# What `monotonically_increasing_id` keeps for the position inside a partition.
_POSITION_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], alias: str = "row_number") -> DataFrame:
    """Every row with its number from 1 in the whole order, without a task that sees more than its share.

    The table is sorted by ranges and written once to the warehouse with each row's range and place in it; numbers
    are the place plus the rows of the ranges before. Ranges are told apart by all order columns, so ``order`` should
    end in a key: rows that tie in all of them share a range and are numbered in any order, once and for all
    when the copy is written. Written, because ranges are drawn anew whenever a sort runs again.
    """
    place = F.monotonically_increasing_id()
    ranged = df.orderBy(*order).withColumns(
        {"__range": F.shiftright(place, _POSITION_BITS), "__place": place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))}
    )
    kept = copy_files(ranged, "numbered")
    counts = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    # One row per range of the sort, that is per shuffle partition; every range is added to those after it.
    before = F.aggregate(
        F.filter(F.col("__all"), lambda r: r["__range"] < F.col("__range")), F.lit(0).cast("bigint"), lambda total, r: total + r["__rows"]
    )
    every = counts.agg(F.collect_list(F.struct("__range", "__rows"))).scalar()
    offsets = counts.withColumn("__all", every).select("__range", before.alias("__before"))
    # As many rows as shuffle partitions.
    placed = kept.join(F.broadcast(offsets), "__range")
    return placed.select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(alias))


def pages(df: DataFrame, size: int, alias: str = "page", number: str = "row_number") -> DataFrame:
    """Add the page, from 1, that a numbered row is on."""
    if size < 1:
        raise ValueError("a page has at least one row")
    return df.withColumn(alias, F.floor((F.col(number) - 1) / F.lit(size)) + 1)


def page(df: DataFrame, which: int, size: int, number: str = "row_number") -> DataFrame:
    """The rows of one page of a numbered table; a page beyond the last one is empty."""
    if which < 1 or size < 1:
        raise ValueError("pages and their rows are counted from 1")
    return df.filter(F.col(number).between((which - 1) * size + 1, which * size))
