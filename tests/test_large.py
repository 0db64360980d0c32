"""Digests, range joins, rule tables, pages, sketches and variants against plain forms."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from aislewise.operators import digests, paging, rules, variants
from aislewise.operators.compare import multiset_difference
from aislewise.operators.range_join import range_join
from aislewise.plans import medians

NULL_FIRST = lambda r: tuple((x is not None, x) for x in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=NULL_FIRST)


# Digests


def test_planted_surplus_on_both_sides(spark):
    first = spark.createDataFrame([(k % 9, None if k % 4 else "x", float(k % 5)) for k in range(200)], "k long, s string, v double")
    more = spark.createDataFrame([(77, "new", 1.0), (None, None, None), (None, None, None)], first.schema)
    second = first.unionByName(first.limit(3)).where("k <> 4 OR k IS NULL").unionByName(more)
    got = digests.compare_buckets(first, second, ["k"], 16)
    assert {r.side for r in got.collect()} == {"only_first", "only_second"}
    assert rows(got) == rows(multiset_difference(first, second))


def test_null_and_neighbouring_columns_are_told_apart(spark):
    first = spark.createDataFrame([("a", None), ("x", "y")], "a string, b string")
    second = spark.createDataFrame([(None, "a"), ("x", "y")], "a string, b string")
    assert digests.compare_buckets(first, second, ["a"], 1).count() == 2


def test_copies_count_and_types_are_brought_together(spark):
    first = spark.createDataFrame([(1, "a")] * 3, "k int, s string")
    assert [(r.side, r.surplus) for r in digests.compare_buckets(first, first.limit(1), ["k"]).collect()] == [("only_first", 2)]
    longer = first.withColumn("k", F.col("k").cast("long")).withColumn("extra", F.lit(1))
    assert digests.compare_buckets(first, longer, ["k"]).count() == 0


def test_equal_and_empty_tables_give_no_row(spark, tables):
    orders = tables("orders")
    report = digests.compare_digests(orders, orders.repartition(5), ["o_orderkey"], 32)
    assert report.where("NOT same").count() == 0 and report.agg(F.sum("rows_first")).first()[0] == orders.count()
    assert digests.compare_buckets(orders, orders.repartition(3), ["o_orderkey"]).count() == 0
    assert digests.compare_buckets(orders.limit(0), orders.limit(0), ["o_orderkey"]).count() == 0
    with pytest.raises(ValueError):
        digests.bucket_digests(orders, ["o_orderkey"], digests.MAX_BUCKETS + 1)


def test_only_rows_of_differing_buckets_reach_the_comparison(spark, tables):
    orders = tables("orders")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 5, 0.0).otherwise(F.col("o_totalprice")))
    report = digests.compare_digests(orders, changed, ["o_orderkey"], 512)
    assert report.where("NOT same").count() == 1
    plan = digests.compare_buckets(orders, changed, ["o_orderkey"], 512)._jdf.queryExecution().optimizedPlan().toString()
    # The semi-join that drops equal buckets lies below the aggregate that shuffles rows.
    assert plan.index("Aggregate") < plan.index("LeftSemi")


# Range joins


def brute(points, intervals, keyed, how):
    out = []
    for k, p in points:
        hit = [
            (s, e)
            for j, s, e in intervals
            if p is not None and (not keyed or (k is not None and j == k)) and (s is None or s <= p) and (e is None or p <= e)
        ]
        out += [(k, p, s, e) for s, e in hit] or ([(k, p, None, None)] if how == "left" else [])
    return sorted(out, key=NULL_FIRST)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("keyed", [True, False])
def test_range_join_of_numbers(spark, how, keyed):
    draw = random.Random(4)
    points = [(draw.choice([0, 1, 2, None]), draw.choice([None, draw.randrange(-60, 60), 7, 7, 0])) for _ in range(150)]
    points += [(0, 2**63 - 1), (1, -(2**63)), (2, -1)]
    ends = [None, -(2**63), -(2**40), -9, -1, 0, 1, 7, 8, 31, 32, 2**40, 2**63 - 1]
    intervals = [(draw.choice([0, 1, 2, None]), draw.choice(ends), draw.choice(ends)) for _ in range(120)]
    left = spark.createDataFrame(points, "k int, p long")
    right = spark.createDataFrame(intervals, "k int, s long, e long")
    got = range_join(left, right if keyed else right.drop("k"), "p", "s", "e", ["k"] if keyed else [], how)
    assert rows(got.select("k", "p", "s", "e")) == brute(points, intervals, keyed, how)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_range_join_of_times(spark, kind):
    draw = random.Random(8)
    base = dt.datetime(1969, 12, 30)
    moment = lambda: base + dt.timedelta(seconds=draw.randrange(900_000), microseconds=draw.choice([0, 1, 999_999]))
    points = [(None, moment()) for _ in range(60)]
    intervals = [(None, draw.choice([None, moment()]), draw.choice([None, moment()])) for _ in range(50)]
    # An end that is also a start, and an interval of one microsecond.
    points.append((None, base))
    intervals += [(None, base, base), (None, base + dt.timedelta(microseconds=1), base + dt.timedelta(days=1))]
    if kind == "date":
        day = lambda d: d and d.date()
        points, intervals = [(k, day(p)) for k, p in points], [(k, day(s), day(e)) for k, s, e in intervals]
    left = spark.createDataFrame(points, f"k int, p {kind}")
    right = spark.createDataFrame(intervals, f"k int, s {kind}, e {kind}").drop("k")
    assert rows(range_join(left, right, "p", "s", "e")) == brute(points, intervals, False, "left")


def test_range_join_of_nothing_and_of_wrong_input(spark):
    left = spark.createDataFrame([(1, 2), (1, None)], "k int, p int")
    right = spark.createDataFrame([(1, 1, 3)], "k int, s int, e int")
    assert rows(range_join(left, right.limit(0), "p", "s", "e", ["k"])) == [(1, None, None, None), (1, 2, None, None)]
    assert range_join(left.limit(0), right, "p", "s", "e", ["k"]).count() == 0
    with pytest.raises(ValueError):
        range_join(left, right, "p", "s", "e")
    with pytest.raises(TypeError):
        range_join(left.withColumn("p", F.col("p").cast("double")), right, "p", "s", "e", ["k"])


def test_long_intervals_are_not_opened(spark):
    right = spark.createDataFrame([(k, -(2**62), 2**62) for k in range(20)], "n int, s long, e long")
    left = spark.createDataFrame([(-(2**62),), (0,), (2**62,)], "p long")
    assert range_join(left, right, "p", "s", "e").count() == 60


# Rules


RULES = "priority int, column string, kind string, value string, label string"


def test_rules_hold_as_a_case_would(spark):
    data = [("bolt", 1, "A red bolt"), ("nut", 2, "Blue Nut"), ("nut", 3, None), (None, 4, "plain"), ("gear", 2, "gear of red"), ("nut", 9, "x")]
    table = [
        (3, "cat", "exact", "nut", "nuts"), (1, "cat", "exact", "gear", "red gear"), (1, "text", "pattern", "^gear.*red$", "red gear"),
        (2, "text", "contains", "RED", "red"), (2, "text", "contains", "purple", "red"), (0, "absent", "exact", "nut", "never"),
        (0, "cat", "exact", "nut", "never"), (1, "id", "exact", "9", "red gear"),
    ]
    df = spark.createDataFrame(data, "cat string, id int, text string")
    got = rules.labelled(df, spark.createDataFrame(table, RULES), "label", "other")
    # The gear lacks the id of its first rule; a rule on an absent column never holds.
    assert [r.label for r in got.orderBy("id", "cat").collect()] == ["red", "red", "nuts", "nuts", "other", "nuts"]
    assert got.columns == ["cat", "id", "text", "label"]


def test_rules_that_repeat_tie_or_are_none(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    table = [(1, "c", "exact", "a", "y"), (1, "c", "exact", "a", "x"), (1, "c", "exact", "a", "x")]
    assert rows(rules.labelled(df, spark.createDataFrame(table, RULES), "label")) == [(None, None), ("a", "x"), ("a", "x")]
    assert rows(rules.labelled(df, spark.createDataFrame([], RULES), "label", "z")) == [(None, "z"), ("a", "z"), ("a", "z")]
    many = [(n, "c", "contains", f"p{n}", "l") for n in range(rules.MAX_PATTERNS + 1)]
    with pytest.raises(ValueError):
        rules.labelled(df, spark.createDataFrame(many, RULES), "label")


# Pages


def test_pages_cover_every_row_once(spark):
    data = [(k * 37 % 1000, "x") for k in range(1000)]
    df = spark.createDataFrame(data, "k int, s string").repartition(7)
    made = paging.numbered(df, [F.desc("k")])
    assert rows(made) == [(k, "x", 1000 - k) for k in range(1000)]
    assert [r.k for r in paging.page(made, 2, 300).orderBy("row_number").collect()] == list(range(699, 399, -1))
    assert paging.page(made, 5, 300).count() == 0 and paging.page(made, 4, 300).count() == 100
    assert {(r.page, r["count"]) for r in paging.pages(made, 400).groupBy("page").count().collect()} == {(1, 400), (2, 400), (3, 200)}


def test_pages_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(None,)] * 20, "k int").repartition(5)
    made = paging.numbered(df, ["k"]).collect()
    assert sorted(r.row_number for r in made) == list(range(1, 521))
    assert all((r.k is None) == (r.row_number <= 20) for r in made)
    assert paging.numbered(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        paging.page(df, 0, 10)


# Medians


def test_median_errors_are_exact_and_within_the_bound(spark):
    draw = random.Random(2)
    data = [(g, q, draw.choice([draw.gauss(0, 9), 5.0])) for g in ("a", None) for q in (1, 2, 4) for _ in range(2000 if g else 3)]
    data += [("a", 1, None), ("b", 2, float("nan")), ("c", 3, 1.0)]
    df = spark.createDataFrame(data, "g string, q int, v double")
    # A large error must show: a sketch this small errs by more than the default one may.
    for size, bound in ((medians.SKETCH_SIZE, medians.RANK_BOUND), (8, 0.0)):
        got = medians.rolling_medians(df, ["g"], "q", "v", 2, size, bound).collect()
        assert {(r.g, r.q) for r in got} >= {("a", q) for q in (1, 2, 3, 4)} | {(None, 4), ("c", 3), ("c", 4)}
        seen = {1: (1,), 2: (1, 2), 3: (2, 3), 4: (3, 4)}
        for r in got:
            values = [v for g, q, v in data if g == r.g and q in seen[r.q] and v is not None and not math.isnan(v)]
            below, upto = sum(v < r["median"] for v in values), sum(v <= r["median"] for v in values)
            assert r.n_values == len(values)
            assert r.rank_error == pytest.approx(max(below / len(values) - 0.5, 0.5 - upto / len(values), 0))
            assert r.within == (r.rank_error <= bound + 1 / len(values))
        if bound:
            assert all(r.within for r in got)
    assert medians.rolling_medians(df.limit(0), ["g"], "q", "v").count() == 0


# Variants


def test_mixed_types_round_trip(spark):
    texts = [
        '{"a":1,"b":"x","c":[1,2],"d":1.5,"e":true}', '{"a":2,"b":null,"c":"no list","f":{"g":1}}', '{"A":9,"h":"only"}', "[1,2]", '"text"', "{}", "null", None,
        '{"a":3,"id":"clash","rest":"clash","odd key.\'x":4}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("v"))
    typed = variants.typed_columns(df, "v")
    kinds = {f.name: f.dataType.simpleString() for f in typed.schema.fields}
    assert kinds["b"] == "string" and kinds["e"] == "boolean" and kinds["rest"] == "variant" and kinds["odd key.'x"] == "bigint"
    assert not {"c", "f", "a", "A"} & set(kinds)
    plain = [c for c in typed.columns if c not in ("id", "rest")]
    for r in typed.withColumn("rest", F.to_json("rest")).collect():
        text = texts[r.id]
        held = {c: float(r[c]) if c == "d" else r[c] for c in plain if r[c] is not None}
        rest = None if r.rest is None else json.loads(r.rest)
        if isinstance(rest, dict) or (rest is None and held):
            rest = {**held, **(rest or {})}
        # Only an empty object leaves nothing behind.
        assert rest == (None if text in (None, "{}") else json.loads(text))


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id int, t string").select("id", F.parse_json("t").alias("v"))
    assert rows(variants.typed_columns(df, "v")) == [(1, None)]
    assert variants.variant_keys(df.limit(0), "v").count() == 0
