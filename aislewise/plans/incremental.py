"""A market-share mart kept up to date release by release.

A release brings added item rows, of new months or late ones of old months. What it changes is known from
the added rows and one small row per key: a key with added rows changes from its first added month on (from
the end of its former tail, if that is earlier), from its lead-in on if that month precedes all it had, and a key without any only grows its tail when the table's
last month moves. Only these keys are computed anew, from the monthly rows since two years before the first change; of the
mart only the months from the first changed one on are rewritten, and rows of other keys in them are copied.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.grouping import ITEM_METRICS
from aislewise.plans.market_share import KEYS, monthly_series, rolled, with_calendar
from aislewise.sources.calendars import month_start

MARGIN = 12


def _same(left: str, right: str):
    """All keys equal, where NULL equals NULL."""
    return " AND ".join(f"{left}.{k} <=> {right}.{k}" for k in KEYS)


class IncrementalMart(NamedTuple):
    """A mart in a folder: ``monthly`` rows as added, one ``spans`` row per key and release, and the ``mart`` by month."""

    spark: SparkSession
    folder: str
    attribute: str = "major_cat"
    start_date: dt.date | str | None = None
    calendar: str = "standard"

    @property
    def first(self) -> dt.date | None:
        return month_start(self.start_date) if self.start_date is not None else None

    def add(self, items: DataFrame, release: int) -> None:
        """Bring the added ``items`` of release number ``release`` (1, 2, ...) into the mart.

        A release that failed half-way is repeated under its number: its rows replace what it left. A release
        without rows changes nothing.
        """
        deltas = self._observed(items)
        path = f"{self.folder}/deltas/release={release}"
        deltas.write.mode("overwrite").parquet(path)
        self._bring(self.spark.read.schema(deltas.schema).parquet(path), release)

    def add_all(self, items: DataFrame, releases: int) -> None:
        """Bring releases 1 to ``releases`` of ``items`` in, each row of that in its column ``release``.

        The items are scanned once for all of them, then the releases follow each other as by :meth:`add`.
        """
        deltas = self._observed(items.where(F.col("release").between(1, releases)), ["release"])
        path = f"{self.folder}/deltas"
        deltas.write.mode("overwrite").partitionBy("release").parquet(path)
        stored = self.spark.read.schema(deltas.schema).parquet(path)
        for release in range(1, releases + 1):
            self._bring(stored.where(F.col("release") == release).drop("release"), release)

    def _observed(self, items: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return monthly_series(items, self.attribute, self.first, self.calendar, True, self.calendar == "standard", also)[0]

    def _bring(self, deltas: DataFrame, release: int) -> None:
        newest = deltas.agg(F.max("date")).first()[0]
        if newest is None:
            return
        known = self._spans(release).groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last")) if release > 1 else None
        before = known.agg(F.max("last")).first()[0] if release > 1 else None
        last = max(newest, before) if before else newest
        touched = deltas.groupBy(*KEYS).agg(F.min("date").alias("d_min"), F.max("date").alias("d_max"))
        work = self._work(touched, known, before, last, release)
        lowest = work.agg(F.min(F.coalesce("since", F.add_months("d_min", -MARGIN)))).first()[0]
        series = deltas
        if known is not None:
            reach = F.add_months(F.lit(lowest), -2 * MARGIN)
            former = self._table("monthly", deltas).where(F.col("date") >= reach).where(F.col("release") < release).drop("release")
            mine = former.alias("f").join(work.alias("w"), F.expr(_same("f", "w")), "left_semi")
            types = {m: deltas.schema[m].dataType for m in ITEM_METRICS}
            series = mine.unionByName(deltas).groupBy("date", *KEYS).agg(*(F.sum(m).cast(t).alias(m) for m, t in types.items()))
        fresh = rolled(series, F.lit(last), self.first).alias("r").join(work.alias("w"), F.expr(_same("r", "w")))
        fresh = fresh.where("since IS NULL OR date >= since").select("r.*")
        if known is not None:
            stored = self._mart(fresh).where(F.col("date") >= F.lit(lowest))
            replaced = F.expr(f"{_same('s', 'w')} AND (w.since IS NULL OR s.date >= w.since)")
            fresh = stored.alias("s").join(work.alias("w"), replaced, "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.folder}/mart")
        self._write(deltas.withColumn("release", F.lit(release)), "monthly", "release", "date")
        spans = touched.withColumnsRenamed({"d_min": "first", "d_max": "last"})
        self._write(spans.withColumn("release", F.lit(release)), "spans", "release")

    def _work(self, touched: DataFrame, known: DataFrame | None, before: dt.date | None, last: dt.date, release: int) -> DataFrame:
        """The keys to compute anew, written: ``since`` is the first month that changes, NULL if the whole series does."""
        if known is None:
            work = touched.withColumn("since", F.lit(None).cast("date"))
        else:
            had = touched.alias("t").join(known.alias("k"), F.expr(_same("t", "k")), "left")
            # Months without rows are filled up to the added one, also those beyond the tail so far.
            since = F.when(F.col("first") <= F.col("d_min"), F.least("d_min", F.add_months("last", MARGIN + 1), F.add_months(F.lit(before), 1)))
            work = had.select("t.*", since.alias("since"))
            if last > before:
                growing = known.where(F.add_months("last", MARGIN) > F.lit(before)).alias("k")
                growing = growing.join(touched.alias("t"), F.expr(_same("k", "t")), "left_anti")
                tail = F.add_months(F.lit(before), 1)
                work = work.unionByName(growing.select(*KEYS, F.lit(None).cast("date").alias("d_min"), F.lit(None).cast("date").alias("d_max"), tail.alias("since")))
        path = f"{self.folder}/work/release={release}"
        work.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(work.schema).parquet(path)

    def read(self) -> DataFrame:
        """The mart as :func:`aislewise.plans.market_share.market_share` builds it from all rows at once."""
        last = self._spans(None).agg(F.max("last")).scalar()
        return with_calendar(self.spark.read.parquet(f"{self.folder}/mart"), last, self.first, self.calendar)

    def _spans(self, below: int | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/spans")
        return rows if below is None else rows.where(F.col("release") < below)

    def _table(self, name: str, like: DataFrame) -> DataFrame:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema.fields)
        return self.spark.read.schema(f"{columns}, release int").parquet(f"{self.folder}/{name}")

    def _mart(self, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/mart").select(*like.columns)

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")
