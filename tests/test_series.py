"""Gap filling, trailing sums and rolling quarters against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from aislewise.operators.densify import fill_months, trailing_gaps, trailing_sums
from aislewise.operators.grouping import rolling_periods


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def random_series(seed, keys, months):
    rng = random.Random(seed)
    rows = []
    for key in keys:
        for i in sorted(rng.sample(range(months), rng.randint(1, 6))):
            rows.append((key, month(i), rng.randint(1, 50)))
    return rows


def brute_fill(rows, first, last):
    by_key = defaultdict(dict)
    for key, m, v in rows:
        if m >= month(first):
            by_key[key][(m.year - 2000) * 12 + m.month - 1] = v
    out = {}
    for key, seen in by_key.items():
        for i in range(max(min(seen) - 12, first), min(max(seen) + 12, last) + 1):
            out[key, month(i)] = seen.get(i, 0)
    return out


def test_fill_months_like_brute_force_with_null_keys(spark):
    for seed in range(4):
        rows = random_series(seed, ["a", "b", None, "", "c"], 60)
        first, last = 8, max((m.year - 2000) * 12 + m.month - 1 for _, m, _ in rows)
        df = spark.createDataFrame(rows, "k string, m date, v int")
        filled = fill_months(df, ["k"], "m", ["v"], F.lit(month(last)), month(first))
        got = [(r.k, r.m, r.v) for r in filled.collect()]
        expected = brute_fill(rows, first, last)
        assert len(got) == len(expected)
        assert {(k, m): v for k, m, v in got} == expected


def test_series_before_the_start_date_leaves_no_rows(spark):
    df = spark.createDataFrame([("old", month(0), 5), ("new", month(30), 7)], "k string, m date, v int")
    filled = fill_months(df, ["k"], "m", ["v"], F.lit(month(30)), month(24))
    assert {r.k for r in filled.collect()} == {"new"}
    assert filled.count() == 7


def test_trailing_sums_like_brute_force(spark):
    rng = random.Random(5)
    rows = [("a", month(i), rng.randint(0, 9), rng.choice([None, 2])) for i in range(30) if i != 17]
    df = spark.createDataFrame(rows, "k string, m date, v int, u int").withColumn("v", F.col("v").cast("decimal(36,8)"))
    out = trailing_sums(df, ["k"], "m", ["v", "u"], may_be_null=["u"])
    at = {r[1]: r for r in rows}
    for r in out.collect():
        i = (r.m.year - 2000) * 12 + r.m.month - 1
        for span in (12, 6, 3):
            window = [at.get(month(j)) for j in range(i - span + 1, i + 1) if j >= 0]
            full = len(window) == span and None not in window
            assert r[f"v_trailing_{span}m"] == (sum(w[2] for w in window) if full else None)
            units = [w[3] for w in window if w and w[3] is not None]
            assert r[f"u_trailing_{span}m"] == (sum(units) if full and units else None)


def test_dense_series_has_gaps_only_in_its_first_eleven_months(spark):
    df = spark.createDataFrame(random_series(1, ["a", "b"], 40), "k string, m date, v int")
    filled = fill_months(df, ["k"], "m", ["v"], F.lit(month(40)))
    gaps = trailing_gaps(filled, ["k"], "m").groupBy("k").count().collect()
    assert {r["count"] for r in gaps} == {11}


def test_rolling_periods_equal_the_full_grid(spark):
    rng = random.Random(9)
    quarters = [f"{y} {q}Q" for y in range(2000, 2004) for q in range(1, 5)]
    facts = [(k, q, rng.randint(1, 99)) for k in "abc" for q in quarters if rng.random() < 0.3]
    df = spark.createDataFrame(facts, "k string, quarter string, v int")
    periods = spark.createDataFrame([(q,) for q in quarters * 2], "quarter string")
    rolled = rolling_periods(df, periods, ["k"], "quarter", {"r": "v"}, 4)
    got = {(r.k, r.quarter): r.r for r in rolled.collect()}
    expected = {}
    for k in "abc":
        for i, q in enumerate(quarters):
            window = [v for kk, qq, v in facts if kk == k and qq in quarters[max(0, i - 3) : i + 1]]
            if window:
                expected[k, q] = sum(window)
    assert got == expected
