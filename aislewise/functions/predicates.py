"""Filter expressions driven by optional parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of(column: str, values: Sequence | None) -> Column:
    """No values chosen keeps every row; otherwise membership, where NULL never matches."""
    chosen = [v for v in values or () if v is not None]
    return F.col(column).isin(chosen) if chosen else F.lit(True)


def page_filter(df: DataFrame, choices: Mapping[str, Sequence | None]) -> DataFrame:
    """Apply every multi-select of a page at once."""
    active = [one_of(c, v) for c, v in choices.items() if v]
    return df.filter(reduce(and_, active)) if active else df


def between_optional(column: str, start=None, end=None) -> Column:
    """``start <= column < end`` with either side optional."""
    tests = []
    if start is not None:
        tests.append(F.col(column) >= F.lit(start))
    if end is not None:
        tests.append(F.col(column) < F.lit(end))
    return reduce(and_, tests) if tests else F.lit(True)


def _condition(condition: Mapping) -> Column:
    value = F.trim(F.lower(F.col(condition["field_name"])))
    hit = value.isin([str(v).lower() for v in condition["values"]])
    return ~hit if condition.get("condition_operator", "IN").upper() == "NOT IN" else hit


def condition_groups(groups: Sequence[Mapping]) -> Column:
    """Case-insensitive allow and deny lists.

    Groups are AND-ed. Conditions inside a group are AND-ed unless the group's
    ``condition_operator`` is ``OR``.
    """
    def fold(group):
        joiner = or_ if group.get("condition_operator", "AND").upper() == "OR" else and_
        return reduce(joiner, [_condition(c) for c in group["conditions"]])

    parts = [fold(g) for g in groups if g.get("conditions")]
    return reduce(and_, parts) if parts else F.lit(True)


def has_text(column: str, text: str) -> Column:
    """Case-insensitive substring search."""
    return F.lower(F.col(column)).contains(text.lower())


def has_pattern(column: str, pattern: str) -> Column:
    """Regular-expression search on the lower-cased text."""
    return F.lower(F.col(column)).rlike(pattern)


def any_level(columns: Sequence[str], value) -> Column:
    """True when the value appears on any of several hierarchy levels."""
    return reduce(or_, [F.col(c) == F.lit(value) for c in columns])
