"""Labels by rules that are rows of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.predicates import has_pattern, has_text

EXACT, CONTAINS, PATTERN = "exact", "contains", "pattern"
# Patterns become expressions of one pass over the rows; more than this many are refused.
MAX_PATTERNS = 2000
_HIT = "array<struct<priority: int, needed: int, label: string>>"


def _needed(rules: DataFrame) -> DataFrame:
    """Each condition with the number of conditions that its rule has; values of one column and kind are one."""
    conditions = rules.groupBy("priority").agg(
        F.count_distinct(F.struct("column", "kind")).cast("int").alias("needed"), F.min("label").alias("label")
    )
    hit = F.struct(F.col("priority").cast("int").alias("priority"), "needed", "label").alias("hit")
    return rules.select("priority", "column", "kind", "value").distinct().join(conditions, "priority").select("column", "kind", "value", hit)


def _pattern_hits(wanted: list) -> list[Column]:
    """One array per condition: its rule if any of its texts or patterns is found."""
    tests = {}
    for r in wanted:
        found = has_text(r["column"], r["value"]) if r["kind"] == CONTAINS else has_pattern(r["column"], r["value"])
        tests.setdefault((tuple(r["hit"]), r["column"], r["kind"]), []).append(F.coalesce(found, F.lit(False)))
    hits = []
    for (hit, _, _), any_of in tests.items():
        one = F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(hit, ("priority", "needed", "label"))]))
        hits.append(F.when(reduce(lambda a, b: a | b, any_of), one).otherwise(F.array()).cast(_HIT))
    return hits


def labelled(df: DataFrame, rules: DataFrame, alias: str, default: str | None = None) -> DataFrame:
    """Add the label of the rule of least ``priority`` that holds, or ``default``.

    ``rules`` has the columns ``(priority, column, kind, value, label)``. The rows of one priority are one rule:
    values of the same column and kind are alternatives, different columns or kinds must all hold. Kinds are
    ``exact`` (the value as text, any number of rows), ``contains`` and ``pattern`` (both on lower-cased text). NULL and
    columns that ``df`` lacks match nothing. If the rows of a priority name several labels, the first in order counts.

    Exact values are equi joins, one for each column that has some, so a list of a million products is a
    join and not an expression. The patterns, few by nature, are read to the driver and tested in one pass; more than
    ``MAX_PATTERNS`` are an error.
    """
    conditions = _needed(rules)
    wanted = conditions.filter(F.col("kind") != EXACT).limit(MAX_PATTERNS + 1).collect()
    if len(wanted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    # A column that the rows lack gives no hit, so a rule that needs it never has all of its conditions.
    parts = _pattern_hits([r for r in wanted if r["column"] in df.columns])
    named = {r[0] for r in conditions.filter(F.col("kind") == EXACT).select("column").distinct().collect()}
    joined = df
    for n, c in enumerate(sorted(named & set(df.columns))):
        values = conditions.filter((F.col("kind") == EXACT) & (F.col("column") == c))
        # The rules that name one value: as many as there are priorities.
        values = values.groupBy(F.col("value").alias(f"__value{n}")).agg(F.collect_list("hit").alias(f"__hits{n}"))
        joined = joined.join(values, F.col(c).cast("string") == F.col(f"__value{n}"), "left")
        parts.append(F.coalesce(F.col(f"__hits{n}").cast(_HIT), F.array().cast(_HIT)))
    if not parts:
        return df.withColumn(alias, F.lit(default).cast("string"))
    hits = F.col("__hits")
    whole = F.filter(hits, lambda h: F.size(F.filter(hits, lambda g: g["priority"] == h["priority"])) == h["needed"])
    best = F.array_min(F.transform(whole, lambda h: F.struct(h["priority"].alias("priority"), h["label"].alias("label"))))
    found = joined.withColumn("__hits", F.concat(*parts)).withColumn("__best", best)
    # A rule may give no label; only rows that no rule holds for get the default.
    label = F.when(F.col("__best").isNull(), F.lit(default)).otherwise(F.col("__best.label"))
    return found.withColumn("__label", label).select(*[F.col(c) for c in df.columns if c != alias], F.col("__label").alias(alias))
