"""Professional-buyer mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORY = (
    "merchant", "web_description", "parent_brand", "brand", "sub_brand", "major_cat", "sub_cat", "minor_cat",
    "merchant_clean",
)


def pro_insights(
    items: DataFrame, pro_items: DataFrame, as_of: dt.date, start: dt.date = dt.date(2023, 1, 1), lag_days: int = 13
) -> DataFrame:
    """Pro purchases given the categories of the item base; products the base does not know are dropped.

    Months from ``start`` up to, not including, the month that was running ``lag_days`` before ``as_of``.
    """
    until = (as_of - dt.timedelta(days=lag_days)).replace(day=1)
    catalogue = (
        items.filter(F.col("major_cat").isNotNull())
        .select(*CATEGORY)
        .distinct()
        .withColumn("__brand", F.lower("brand"))
        .withColumnsRenamed({"merchant": "__merchant"})
    )
    window = pro_items.filter((F.col("month") >= F.lit(start)) & (F.col("month") < F.lit(until)))
    bought = window.withColumn("__lower", F.lower("brand")).drop("brand")
    same = (
        (F.col("merchant") == F.col("__merchant"))
        & (F.col("product_description") == F.col("web_description"))
        & (F.col("__lower") == F.col("__brand"))
    )
    return bought.join(catalogue, same).drop("__merchant", "__brand", "__lower", "product_description")
