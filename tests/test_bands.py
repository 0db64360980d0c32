"""Price-band shares on small charts against a plain computation, with thin and sufficient samples."""

from __future__ import annotations

import random
import statistics
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aislewise.plans import pricing

QUARTERS = [f"{y} {q}Q" for y in (1999, 2000, 2001) for q in (1, 2, 3, 4)]
COLUMNS = "quarter string, department string, class string, sub_class string, merchant string, channel string, item_price decimal(10,2), gmv decimal(18,4), count long"


def rows():
    rng = random.Random(3)
    found = []
    for _ in range(400):
        price = Decimal(rng.randrange(0, 600))
        found.append((
            rng.choice(QUARTERS[:9]), rng.choice(["A", "B"]), rng.choice(["x", "y"]), rng.choice(["s", "t"]),
            rng.choice(["m1", "m2", "m3", "m4"]), rng.choice(["Online", "In-Store"]), price, Decimal(rng.randrange(1, 90)), 2,
        ))
    # A department below the sample, and one row whose department is unknown.
    return found + [("1999 1Q", "thin", "x", "s", "m1", "Online", Decimal(5), Decimal(7), 1), ("1999 1Q", None, "x", "s", "m1", "Online", Decimal(5), Decimal(7), 900)]


def band(price):
    return "ABCDE"[min(int(price) // 100, 4)]


def expected():
    """Gmv of (quarter, merchant, band) and samples of (quarter, department, class, merchant, channel, band)."""
    gmv, sample = defaultdict(Decimal), defaultdict(int)
    for quarter, department, cls, _, merchant, channel, price, value, _ in rows():
        if department not in ("A", "B"):
            continue
        at = QUARTERS.index(quarter)
        for later in QUARTERS[at : at + 4]:
            gmv[later, merchant, band(price)] += value
            sample[later, department, cls, merchant, channel, band(price)] += 1
    return gmv, sample


@pytest.fixture(scope="module")
def charts(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="module")
def quarters(spark):
    return spark.createDataFrame([(q,) for q in QUARTERS], "quarter string")


def flags(min_avg, min_median):
    sizes = defaultdict(list)
    for key, n in expected()[1].items():
        sizes[key[-1]].append(n)
    return (
        sum(statistics.mean(s) < min_avg for s in sizes.values()),
        sum(statistics.median(s) < min_median for s in sizes.values()),
    )


@pytest.mark.parametrize("limits", [(1, 1), (2.5, 1), (1, 2.5)])
def test_band_share(charts, quarters, limits):
    gmv, _ = expected()
    per_band, total = defaultdict(Decimal), defaultdict(Decimal)
    for (quarter, _, b), value in gmv.items():
        per_band[quarter, b] += value
        total[quarter] += value
    found = pricing.band_share(charts, quarters, 0, 100, min_sample=100, min_avg=limits[0], min_median=limits[1]).collect()
    assert 0 in flags(*limits)
    assert {(r.sample_size_flag_avg, r.sample_size_flag_median) for r in found} == {flags(*limits)}
    assert {(r.quarter, r.price_band[0]): r.market_share for r in found} == pytest.approx(
        {(q, b): float(v) / float(total[q]) for (q, b), v in per_band.items()}
    )


def test_band_share_merchant_pools_others(charts, quarters):
    gmv, _ = expected()
    sums, total = defaultdict(Decimal), defaultdict(Decimal)
    for (quarter, merchant, b), value in gmv.items():
        if b == "B":
            sums[merchant] += value
            total[quarter] += value
    top = sorted(sums, key=sums.get, reverse=True)[:2]
    shares = defaultdict(Decimal)
    for (quarter, merchant, b), value in gmv.items():
        if b == "B" and quarter >= "2000 1Q":
            shares[quarter, merchant if merchant in top else "Other Retailers"] += value
    found = pricing.band_share_merchant(
        charts, quarters, 0, 100, "B", first_quarter="2000 1Q", top=2, min_sample=100, min_avg=1, min_median=1
    ).collect()
    assert {(r.quarter, r.final_name): r.market_share for r in found} == pytest.approx(
        {(q, m): float(v) / float(total[q]) for (q, m), v in shares.items()}
    )


def test_hidden_where_both_samples_are_thin(charts, quarters):
    limits = {"min_sample": 100, "min_avg": 1000, "min_median": 1000}
    assert pricing.band_share(charts, quarters, 0, 100, **limits).count() == 0
    assert pricing.band_export(charts, quarters, 0, 100, **limits).count() == 0


def test_hidden_without_a_step(charts, quarters):
    shown = pricing.band_share(charts, quarters, 0, 0, min_sample=100, min_avg=1, min_median=1)
    assert shown.count() == 0 and "sample_size_flag_avg" in shown.columns


def test_export_keeps_every_key(charts, quarters):
    found = pricing.band_export(charts, quarters, 0, 100, min_sample=100, min_avg=1, min_median=1)
    sums = found.groupBy("quarter", "retailer", F.substring("price_band", 1, 1).alias("b")).agg(F.sum("rolling_4q_merchant_gmv").alias("g"))
    assert {(r.quarter, r.retailer, r.b): r.g for r in sums.collect()} == dict(expected()[0])
