"""Active users over time and distinct users at several grains, from one pass over the events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.periods import floor_to


def rolling_active(events: DataFrame, user: str, date: str, months: int = 24) -> DataFrame:
    """``(month, active_users, started, lapsed)``: users with an event in the ``months`` months that end with each month.

    The months after an event are an interval; a user's intervals are united, so each united interval is one
    beginning and one end, and a running sum over the months of these counts the users. A user has as many
    rows as intervals, not as months; the running sum has a row per month. ``started`` are users active now
    and not a month before. Events without a user or date take no part; months run from the first event's to
    the last event's, gaps included.
    """
    seen = events.select(F.col(user).alias("user"), floor_to("month", F.col(date)).alias("month")).where("user IS NOT NULL AND month IS NOT NULL").distinct()
    by_user = Window.partitionBy("user").orderBy("month")
    reach = F.add_months("month", months)
    after, before = F.lead("month").over(by_user), F.lag("month").over(by_user)
    # An interval goes on where the next one begins no later than it ends.
    begins = F.coalesce(F.add_months(before, months) < F.col("month"), F.lit(True))
    ends = F.coalesce(after > reach, F.lit(True))
    edges = seen.select("month", reach.alias("reach"), begins.alias("begins"), ends.alias("ends"))
    steps = F.array(
        F.struct(F.col("month").alias("at"), F.col("begins").cast("int").alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("reach").alias("at"), F.lit(0).alias("up"), F.col("ends").cast("int").alias("down")),
    )
    swept = edges.select(F.inline(steps)).groupBy(F.col("at").alias("month")).agg(F.sum("up").alias("started"), F.sum("down").alias("lapsed"))
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    running = swept.withColumn("active_users", F.sum(F.col("started") - F.col("lapsed")).over(so_far))
    # Every month with an event has a row already, though one without steps of its own repeats the last count.
    newest = seen.agg(F.max("month")).scalar()
    spread = running.withColumn("until", F.coalesce(F.add_months(F.lead("month").over(Window.orderBy("month")), -1), F.col("month")))
    months_of = F.explode(F.sequence("month", F.least(F.greatest("until", "month"), newest), F.expr("interval 1 month"))).alias("each")
    first = F.col("each") == F.col("month")
    return spread.where(F.col("month") <= newest).select("month", "active_users", "started", "lapsed", "until").select(
        months_of, "month", "active_users", "started", "lapsed"
    ).select(
        F.col("each").alias("month"), "active_users",
        F.when(first, F.col("started")).otherwise(0).alias("started"), F.when(first, F.col("lapsed")).otherwise(0).alias("lapsed"),
    )


def period_views(month: Column, last: Column) -> Mapping[str, Column]:
    """The first month of a month's period under each view; NULL where the view leaves the month out."""
    return {
        "month": month,
        "quarter": floor_to("quarter", month),
        "year": floor_to("year", month),
        "year to date": F.when(F.month(month) <= F.month(last), floor_to("year", month)),
        "all": F.to_date(F.lit("0001-01-01")),
    }


def distinct_by_view(items: DataFrame, month: str, counted: Mapping[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """``(view, period, <by>, <name>...)``: exact distinct counts of integer columns at month, quarter, year, year to date and in all.

    ``counted`` maps result names to columns. The items are read and grouped once, by month: the values of a
    block of 32,768 neighbouring numbers are one bitmap, and a longer period unites the bitmaps of its months
    block by block. Missing values are not counted, rows without a month take no part. Counts shuffle bitmaps
    of at most 4 KiB, however often a value occurs.
    """
    rows = items.where(F.col(month).isNotNull())
    names = list(counted)
    ids = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("id")) for n, c in counted.items()))
    single = rows.select(F.col(month).alias("month"), *by, F.inline(ids)).where("id IS NOT NULL")
    blocks = single.groupBy("month", *by, "name", F.bitmap_bucket_number("id").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )
    last = blocks.agg(F.max("month")).scalar()
    labels = F.array(*(F.struct(F.lit(v).alias("view"), p.alias("period")) for v, p in period_views(F.col("month"), last).items()))
    viewed = blocks.select("*", F.inline(labels)).where("period IS NOT NULL")
    united = viewed.groupBy("view", "period", *by, "name", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    counts = united.select("view", "period", *by, "name", F.bitmap_count("bits").alias("n"))
    each = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    return counts.groupBy("view", "period", *by).agg(*each)
