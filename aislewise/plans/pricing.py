"""Price marts: class roll-ups, priced items, chart base, price bands and band shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislewise.functions import labels
from aislewise.functions.measures import ratio
from aislewise.functions.predicates import page_filter
from aislewise.operators.grouping import label_others, null_safe_join, rolling_periods, top_n, with_group_totals
from aislewise.plans.brands import _final_merchant
from aislewise.plans.sku import product_hash


def class_rollup(
    items: DataFrame, rollups: Mapping[str, Sequence[str]], department: str | None = None
) -> DataFrame:
    """Repeat each row under every roll-up class that contains its class, and under its own class.

    ``old_class`` keeps the own class for own rows and the roll-up name otherwise. Rows without a
    department are dropped. One scan, each row exploded into at most ``len(rollups) + 1`` copies.
    """
    inside = F.lit(True) if department is None else F.col("department") == department
    memberships = [F.when(inside & F.col("class").isin(list(members)), F.lit(name)) for name, members in rollups.items()]
    own = F.struct(F.col("class").alias("class"), F.col("class").alias("old_class"))
    rolled = [F.when(m.isNotNull(), F.struct(m.alias("class"), m.alias("old_class"))) for m in memberships]
    kept = items.filter(F.col("department").isNotNull())
    spread = kept.withColumn("__class", F.explode(F.array(*rolled, own))).filter(F.col("__class").isNotNull())
    return spread.withColumns({"class": F.col("__class.class"), "old_class": F.col("__class.old_class")}).drop("__class")


# Lots that items are dealt to before they are summed. A lot is worked on by one task.
PRICE_PARTS = 256


def price_item_base(items: DataFrame) -> DataFrame:
    """Products per quarter and month with smallest, largest and quantity-weighted price.

    ``sku``, if the items have it, is the number that ``upc`` is the text of; items dealt by it are not moved again.
    Items are summed with the description as a key, which hashing can do, and only the sums are sorted for its largest value.
    """
    number = ["sku"] if "sku" in items.columns else []
    keys = [*number, "quarter", "month", "department", "class", "sub_class", "brand", "upc", "web_description", "merchant", "channel"]
    spend = F.col("item_price") * F.col("item_quantity")
    hashed = items.filter(F.col("department").isNotNull()).groupBy(*keys, "product_description").agg(
        F.max("item_price").alias("item_price_max"),
        F.min("item_price").alias("item_price_min"),
        F.sum("item_quantity").alias("sum_item_quantity"),
        F.sum(spend).alias("sum_dollars"),
        F.sum("gmv").alias("gmv"),
    )
    totals = {c: F.sum(c).cast(hashed.schema[c].dataType) for c in ("sum_item_quantity", "sum_dollars", "gmv")}
    base = hashed.groupBy(*keys).agg(
        F.max("product_description").alias("product_description"),
        F.max("item_price_max").alias("item_price_max"),
        F.min("item_price_min").alias("item_price_min"),
        totals["sum_item_quantity"].alias("sum_item_quantity"),
        totals["sum_dollars"].alias("sum_dollars"),
        ratio(totals["sum_dollars"], totals["sum_item_quantity"]).alias("item_price_avg"),
        totals["gmv"].alias("gmv"),
    )
    digest = product_hash(F.col("web_description"), F.col("brand"), F.col("merchant"), F.col("upc"))
    return base.drop(*number).withColumn("sku", digest)


CHART_KEYS = ("quarter", "department", "class", "sub_class", "merchant", "channel", "item_price")


def price_totals(items: DataFrame, since_quarter: str | None = None) -> DataFrame:
    """Gmv per quarter, category, raw merchant, channel and price: what :func:`charts_base` needs of the items.

    Rolling classes up may follow instead of precede it, so that it repeats sums instead of items. The sums stay dealt by the keys
    that neither roll-ups nor final merchants change, in one shuffle for all sums of the charts.
    """
    kept = items.filter(F.col("department").isNotNull())
    if since_quarter is not None:
        kept = kept.filter(F.col("quarter") >= since_quarter)
    dealt = kept.repartition(PRICE_PARTS, "quarter", "department", "sub_class", "channel", "item_price")
    return dealt.groupBy(*CHART_KEYS).agg(F.sum("gmv").alias("gmv"))


def charts_base(items: DataFrame, mapping: DataFrame, since_quarter: str | None = None) -> DataFrame:
    """Gmv per quarter, category, final merchant, channel and price.

    ``count`` is the number of raw-merchant price rows behind a line, not the number of items.
    """
    keys = CHART_KEYS
    kept = items.filter(F.col("department").isNotNull())
    if since_quarter is not None:
        kept = kept.filter(F.col("quarter") >= since_quarter)
    priced = kept.groupBy(*keys).agg(F.sum("gmv").alias("gmv"))
    final = _final_merchant(priced, mapping)
    return (
        final.groupBy(*keys)
        .agg(F.sum("gmv").alias("gmv"), F.count("item_price").alias("count"))
        .withColumn("channel", labels.channel_title(F.col("channel"), keep_unknown=True))
    )


def price_band_table(spark: SparkSession, start: int, step: int) -> DataFrame:
    """The five bands with their limits, for a page's band picker."""
    names = labels.price_band_labels(start, step)
    lows = [start + i * step for i in range(5)]
    highs = [*(str(low + step) for low in lows[:4]), "+"]
    rows = [(name[0], low, high, name) for name, low, high in zip(names, lows, highs)]
    return spark.createDataFrame(rows, "label string, min int, max string, descr string")


def sample_guard(charts: DataFrame) -> DataFrame:
    """Chart rows with the sample behind their department, class, sub-class and merchant."""
    return with_group_totals(
        charts,
        "count",
        {
            "major_sample": ["department"],
            "sub_sample": ["class"],
            "minor_sample": ["sub_class"],
            "major_merchant_sample": ["department", "merchant"],
        },
    )


BAND_KEYS = ("department", "class", "sub_class", "merchant", "channel", "price_band")
MIN_DEPARTMENT_SAMPLE = 1500
MIN_AVG_SAMPLE = 20
MIN_MEDIAN_SAMPLE = 8


def _banded(charts: DataFrame, start: int, step: int, choices: Mapping[str, Sequence] | None, min_sample: int) -> DataFrame:
    """Gmv and row count per quarter, category, merchant, channel and band, thin departments removed."""
    # Prices are summed to bands first; the total of a department is a window over these few rows, not a second pass over the charts.
    banded = (
        page_filter(charts, choices or {})
        .withColumn("price_band", labels.price_band(F.col("item_price"), start, step))
        .groupBy("quarter", *BAND_KEYS)
        .agg(F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("sample_size"), F.sum("count").alias("__counted"))
    )
    guarded = banded.withColumn("major_sample", F.sum("__counted").over(Window.partitionBy("department")))
    kept = guarded.filter(F.col("major_sample") > min_sample).dropna(subset=["quarter", "department", "merchant", "channel"])
    return kept.drop("__counted", "major_sample")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], parts: int = 64) -> DataFrame:
    """Interpolated percentiles per group, whose values are never together in one task.

    Values are counted first. Approximate quantiles of each group only divide its different values into
    ``parts`` stretches; running counts within a stretch, on top of the counts of the stretches below, give
    every value its exact rank, and the two neighbours of each percentile are picked and interpolated.
    """
    group = [*keys] or ["__all"]
    counted = df.filter(F.col(value).isNotNull())
    counted = counted if keys else counted.withColumn("__all", F.lit(0))
    counted = counted.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = counted.groupBy(*group).agg(F.percentile_approx("__v", shares, F.lit(1000)).alias("__cuts"), F.sum("__n").alias("__total"))
    # Without keys there is one row of cuts.
    placed = null_safe_join(counted, cuts if keys else F.broadcast(cuts), group, "inner")
    # Holds for every row, and keeps the totals in the plan of the stretches too, which then share the counts and their shuffle.
    placed = placed.filter(F.col("__total") > 0)
    placed = placed.withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    below = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = placed.groupBy(*group, "__part").agg(F.sum("__n").alias("__sum"))
    stretches = stretches.select(*group, "__part", F.coalesce(F.sum("__sum").over(below), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(placed, stretches, [*group, "__part"], "inner")
    ranked = ranked.withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    picked, shown = [F.first("__total").alias("__total")], []
    for name, p in points.items():
        at = (F.col("__total") - 1) * p
        for side, rank in (("lower", F.floor(at)), ("upper", F.ceil(at))):
            picked.append(F.min(F.when(F.col("__upto") > rank, F.col("__v"))).cast("double").alias(f"__{side}_{name}"))
        low, high = F.col(f"__lower_{name}"), F.col(f"__upper_{name}")
        mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        shown.append(F.when(F.ceil(at) == F.floor(at), low).otherwise(mixed).alias(name))
    return ranked.groupBy(*group).agg(*picked).select(*keys, *shown)


def _thin_sample_flags(rolled: DataFrame, min_avg: float, min_median: float) -> DataFrame:
    """One row: how many bands have a thin average and how many a thin median rolling sample.

    Samples are those of a department, class, merchant, channel and band; sub-classes are summed, so the
    result does not depend on their order inside a quarter.
    """
    size = "rolling_sample_size"
    summed = rolled.groupBy("quarter", *[k for k in BAND_KEYS if k != "sub_class"]).agg(F.sum(size).alias(size))
    averages = summed.groupBy("price_band").agg(ratio(F.sum(size), F.count(size)).alias("avg_size"))
    medians = exact_percentiles(summed, ["price_band"], size, {"median_size": 0.5})
    return averages.join(medians, "price_band").agg(
        F.count_if(F.col("avg_size") < min_avg).alias("sample_size_flag_avg"),
        F.count_if(F.col("median_size") < min_median).alias("sample_size_flag_median"),
    )


def _shown(result: DataFrame, flags: DataFrame, start: int, step: int) -> DataFrame:
    """Attach the flags; hide everything for an unset price step or when both samples are thin."""
    names = ("sample_size_flag_avg", "sample_size_flag_median")
    if step == 0 or start + step == 0:
        return result.withColumns({n: F.lit(None).cast("long") for n in names}).filter(F.lit(False))
    shown = flags.filter((F.col(names[0]) == 0) | (F.col(names[1]) == 0))
    # Named once: no row where the subquery has none, and no second copy of its plan for a filter.
    return result.select("*", F.inline(F.array_compact(F.array(shown.select(F.struct(*names)).scalar()))))


def _rolled(banded: DataFrame, quarters: DataFrame) -> DataFrame:
    """Gmv and sample of four quarters per band key, from one pass over the facts.

    The condition holds for every row, as each has a sample. It keeps both sums in the plan of a reader that
    takes only one of them: all readers then share the shuffle of the facts.
    """
    sums = {"rolling_merchant_gmv": "gmv", "rolling_sample_size": "sample_size"}
    rolled = rolling_periods(banded, quarters, BAND_KEYS, "quarter", sums, 4)
    return rolled.filter(F.greatest("rolling_sample_size", "rolling_merchant_gmv") > 0)


def _sold(rolled: DataFrame) -> DataFrame:
    return rolled.filter(F.col("rolling_merchant_gmv").isNotNull()).drop("rolling_sample_size")


def _share_of_quarter() -> Column:
    """Part of a quarter's gmv; a quarter has a line per shown merchant or band, so the window stays small."""
    return ratio(F.col("segment_gmv"), F.sum("segment_gmv").over(Window.partitionBy("quarter")))


def _quarter_range(column: str, first: str | None, last: str | None) -> Column:
    test = F.lit(True)
    if first is not None:
        test = test & (F.col(column) >= first)
    if last is not None:
        test = test & (F.col(column) <= last)
    return test


def band_share_merchant(
    charts: DataFrame,
    quarters: DataFrame,
    start: int,
    step: int,
    band: str,
    choices: Mapping[str, Sequence] | None = None,
    shown_quarters: Sequence[str] | None = None,
    first_quarter: str | None = None,
    last_quarter: str | None = None,
    top: int = 10,
    min_sample: int = MIN_DEPARTMENT_SAMPLE,
    min_avg: float = MIN_AVG_SAMPLE,
    min_median: float = MIN_MEDIAN_SAMPLE,
) -> DataFrame:
    """Rolling four-quarter share of each merchant inside one price band, merchants beyond the top pooled."""
    rolled = _rolled(_banded(charts, start, step, choices, min_sample), quarters)
    wanted = dict(zip("ABCDE", labels.price_band_labels(start, step))).get(band[0], labels.price_band_labels(start, step)[4])
    # The band is picked inside the sum: as a filter it would move below the shuffle that the sample flags share.
    inside = F.when(F.col("price_band") == wanted, F.col("rolling_merchant_gmv"))
    segment = (
        _sold(rolled)
        .groupBy("quarter", F.col("merchant").alias("final_name"))
        .agg(F.sum(inside).alias("segment_gmv"), F.count(inside).alias("__rows"))
        .filter(F.col("__rows") > 0)
        .drop("__rows")
    )
    kept = top_n(segment, "final_name", "segment_gmv", top)
    shares = (
        label_others(page_filter(segment, {"quarter": shown_quarters}), kept, "final_name", labels.OTHER_RETAILERS, top)
        .filter(_quarter_range("quarter", first_quarter, last_quarter))
        .groupBy("quarter", "final_name")
        .agg(F.sum("segment_gmv").alias("segment_gmv"))
        .select("quarter", "final_name", _share_of_quarter().alias("market_share"))
    )
    return _shown(shares, _thin_sample_flags(rolled, min_avg, min_median), start, step)


def band_share(
    charts: DataFrame,
    quarters: DataFrame,
    start: int,
    step: int,
    choices: Mapping[str, Sequence] | None = None,
    shown_quarters: Sequence[str] | None = None,
    first_quarter: str | None = None,
    last_quarter: str | None = None,
    min_sample: int = MIN_DEPARTMENT_SAMPLE,
    min_avg: float = MIN_AVG_SAMPLE,
    min_median: float = MIN_MEDIAN_SAMPLE,
) -> DataFrame:
    """Rolling four-quarter share of each price band."""
    rolled = _rolled(_banded(charts, start, step, choices, min_sample), quarters)
    segment = _sold(rolled).groupBy("quarter", "price_band").agg(
        F.sum("rolling_merchant_gmv").alias("segment_gmv")
    )
    shares = (
        page_filter(segment, {"quarter": shown_quarters})
        .filter(_quarter_range("quarter", first_quarter, last_quarter))
        .select("quarter", "price_band", _share_of_quarter().alias("market_share"))
    )
    return _shown(shares, _thin_sample_flags(rolled, min_avg, min_median), start, step)


def band_export(
    charts: DataFrame,
    quarters: DataFrame,
    start: int,
    step: int,
    choices: Mapping[str, Sequence] | None = None,
    first_quarter: str | None = None,
    last_quarter: str | None = None,
    min_sample: int = MIN_DEPARTMENT_SAMPLE,
    min_avg: float = MIN_AVG_SAMPLE,
    min_median: float = MIN_MEDIAN_SAMPLE,
) -> DataFrame:
    """Rolling gmv per quarter, channel, category, retailer and band, as exported from the page."""
    rolled = _rolled(_banded(charts, start, step, choices, min_sample), quarters)
    rows = (
        _sold(rolled)
        .filter(_quarter_range("quarter", first_quarter, last_quarter))
        .select(
            "quarter", "channel", "department", "class", "sub_class", F.col("merchant").alias("retailer"), "price_band",
            F.col("rolling_merchant_gmv").alias("rolling_4q_merchant_gmv"),
        )
    )
    shown = _shown(rows, _thin_sample_flags(rolled, min_avg, min_median), start, step)
    return shown.drop("sample_size_flag_avg", "sample_size_flag_median")


def price_quantiles(items: DataFrame, keys: Sequence[str] = (), price: str = "item_price_avg") -> DataFrame:
    """Price points that suggest a first price and a step for the bands."""
    points = exact_percentiles(items, keys, price, {"starting": 0.2, "median": 0.5, "last": 0.8})
    return points.withColumns(
        {"step": (F.col("last") - F.col("starting")) / 4, "m80": F.col("last") / 4}
    )
