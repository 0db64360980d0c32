"""Calendar-period expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display intervals offered by the share views (fixed values).
DISPLAY_INTERVALS = (
    "Annually",
    "Quarterly",
    "Monthly",
    "Year-to-Date",
    "Trailing 12 Months",
    "Trailing 6 Months",
    "Trailing 3 Months",
)

# Length of each trailing interval in months.
TRAILING_SPANS = {"Trailing 12 Months": 12, "Trailing 6 Months": 6, "Trailing 3 Months": 3}

_GRAIN = {"Annually": "year", "Year-to-Date": "year", "Quarterly": "quarter", "Weekly": "week"}


def moment(value, kind="timestamp") -> Column:
    """A point in time as written, in the session's time zone whatever the driver's zone is."""
    return F.lit(str(value)).cast(kind)


def floor_to(grain: str, day: Column) -> Column:
    """First day of the year, quarter, month or week that holds ``day``."""
    return F.trunc(day, grain)


def end_of(grain: str, day: Column) -> Column:
    """Last day of the year, quarter or month that holds ``day``."""
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    return F.date_add(F.add_months(floor_to(grain, day), months), -1)


def interval_start(interval: str, day: Column) -> Column:
    """Period a row is shown under for a display interval; trailing views keep the month."""
    return floor_to(_GRAIN.get(interval, "month"), day)


def month_factor(span: int, month: Column) -> Column:
    """Position of a month inside its year (12), half year (6) or quarter (3).

    Over ``span`` consecutive months the positions add up to 78, 21 or 6.
    """
    return (F.month(month) - 1) % span + 1


FACTOR_TOTAL = {12: 78, 6: 21, 3: 6}
