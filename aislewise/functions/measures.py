"""Metric expressions shared by all marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC = "decimal(36,8)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def implied_units(gmv: Column, spend: Column, quantity: Column) -> Column:
    """Units for the whole market: gmv divided by the observed average selling price."""
    return F.try_divide(gmv.cast("double"), ratio(spend, quantity))


def metric(value: Column) -> Column:
    """Fixed-point metric. Casting before a window keeps sums independent of row order."""
    return value.cast(METRIC)
