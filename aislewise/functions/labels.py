"""Label expressions: defaults, cohorts, bands and status texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNBRANDED = "unbranded"
NO_MERCHANT = "no merchant"
OTHER_CATEGORIES = "Other Categories"
OTHER_BRANDS = "Other Brands"
OTHER_RETAILERS = "Other Retailers"

# Brand spellings that mean "no brand" in the regional mart (fixed values).
BLANK_BRANDS = ("Unknown", "", "Unknown Brand")

# Age bands and the cohort each belongs to (fixed values).
AGE_COHORTS = (
    (("55-64", "65+"), "boomer_plus"),
    (("45-54",), "gen_x"),
    (("35-44", "25-34"), "millenial"),
    (("21-24", "18-20", "18-24"), "gen_z"),
)
AGE_COHORT_TITLES = {
    "boomer_plus": "Boomer+",
    "gen_x": "Gen X",
    "millenial": "Millenial",
    "gen_z": "Gen Z",
}

CHANNEL_TITLES = {"B&M": "In-Store", "ONLINE": "Online"}

# Row-count classes: lower bound, name, usual running time (fixed values).
SIZE_CLASSES = (
    (80266288, "very large", 100),
    (11915983, "large", 45),
    (4373925, "medium", 40),
    (0, "small", 25),
)


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Ordered CASE: the first rule that holds gives the label."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    (test, label), *rest = rules
    chain = reduce(lambda acc, r: acc.when(r[0], lit(r[1])), rest, F.when(test, lit(label)))
    return chain.otherwise(lit(default))


def brand_or(default: str, brand: Column, blanks: Sequence[str] = ()) -> Column:
    """Replace a missing brand, and any spelling listed in ``blanks``."""
    value = F.when(brand.isin(list(blanks)), None).otherwise(brand) if blanks else brand
    return F.coalesce(value, F.lit(default))


def clean_brand(brand: Column) -> Column:
    return F.coalesce(F.upper(brand), F.lit("UNBRANDED"))


def age_cohort(age: Column) -> Column:
    return first_match([(age.isin(list(ages)), name) for ages, name in AGE_COHORTS])


def age_cohort_title(age: Column) -> Column:
    return first_match([(age.isin(list(ages)), AGE_COHORT_TITLES[name]) for ages, name in AGE_COHORTS])


def channel_title(channel: Column, keep_unknown: bool = False) -> Column:
    """Customer-facing channel name; an unknown code is kept or becomes NULL."""
    rules = [(channel == code, title) for code, title in CHANNEL_TITLES.items()]
    return first_match(rules, channel if keep_unknown else None)


def size_class(rows: Column) -> Column:
    return first_match([(rows >= low, name) for low, name, _ in SIZE_CLASSES])


def running_time(rows: Column) -> Column:
    return first_match([(rows >= low, minutes) for low, _, minutes in SIZE_CLASSES])


def sample_risk(sample_size: Column) -> Column:
    return first_match([(sample_size > 1000, "Low Risk"), (sample_size > 250, "Some Risk")], "High Risk")


def price_band_labels(start: int, step: int) -> list[str]:
    """Five bands, the last one open."""
    edges = [start + i * step for i in range(5)]
    closed = [f"{c}. ({lo} - {lo + step})" for c, lo in zip("ABCD", edges)]
    return [*closed, f"E. ({edges[4]} +)"]


def price_band(price: Column, start: int, step: int) -> Column:
    labels = price_band_labels(start, step)
    return first_match([(price < start + (i + 1) * step, labels[i]) for i in range(4)], labels[4])
