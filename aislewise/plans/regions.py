"""Geographic mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import BLANK_BRANDS, OTHER_BRANDS, brand_or
from aislewise.operators.grouping import label_others

KEYS = ("state", "month", "parent_brand", "brand", "sub_brand", "merchant", "major_cat", "sub_cat", "minor_cat")


def geographic_analysis(items: DataFrame, state_names: DataFrame, min_rows: int = 1000) -> DataFrame:
    """Monthly metrics per state, with parent brands outside the well-observed brands pooled.

    Items are summed to the report keys first, so the brand and state joins touch few rows and a
    dominant brand is already collapsed. ``observed_spend`` adds up item prices.
    """
    top_brands = items.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows).select(
        F.col("brand").alias("parent_brand")
    )
    summed = (
        items.withColumns(
            {"brand": brand_or("Unbranded", F.col("brand"), BLANK_BRANDS), "merchant": F.col("merchant_clean")}
        )
        .groupBy(*KEYS)
        .agg(
            F.sum("gmv").alias("gmv"),
            F.count(F.lit(1)).alias("sample_size"),
            F.sum("item_price").alias("observed_spend"),
            F.sum("item_quantity").alias("observed_units"),
        )
    )
    named = state_names.select(F.col("state").alias("__code"), "state_name")
    labelled = label_others(summed, top_brands, "parent_brand", OTHER_BRANDS)
    placed = labelled.join(named, F.col("state") == F.col("__code"), "left").withColumn("state", F.col("state_name"))
    return placed.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("gmv", "sample_size", "observed_spend", "observed_units")]
    )


def with_projected_month(mart: DataFrame, source_month, new_month, uplift: float = 1.15) -> DataFrame:
    """Append a copy of one month under a later month with gmv raised, as a release rehearsal does."""
    gmv_type = mart.schema["gmv"].dataType
    copied = mart.filter(F.col("month") == F.lit(source_month)).withColumns(
        {"month": F.lit(new_month).cast("date"), "gmv": (F.col("gmv") * F.lit(str(uplift)).cast("decimal(6,4)")).cast(gmv_type)}
    )
    return mart.unionByName(copied)
