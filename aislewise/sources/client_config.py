"""Client configuration: form submissions turned into typed settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.grouping import latest_by

# Package names of the form and the setting each one switches on (fixed values).
PACKAGES = {
    "market_share": "Market Share",
    "shopper_insights": "Shopper Insights",
    "pro_module": "Pro",
    "pricing_n_promo": "Pricing & Promo",
}
TIMESTAMP_FORMAT = "M/d/yyyy H:mm:ss"


def read_config_csv(spark: SparkSession, path: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Form export with a header row; ``renames`` maps long form questions to column names."""
    form = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return form.withColumnsRenamed(dict(renames or {}))


def list_text(value: Column) -> Column:
    """``"['a', 'b']"`` becomes an array, any other text a one-element array, NULL an empty one."""
    text = F.trim(value)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    items = F.transform(
        F.regexp_extract_all(inner, F.lit(r"('[^']*'|\"[^\"]*\"|[^,\s][^,]*)"), 1),
        lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""),
    )
    listed = text.startswith("[") & text.endswith("]")
    empty = F.array().cast("array<string>")
    return F.when(value.isNull(), empty).when(listed, items).otherwise(F.array(text))


def any_date(value: Column) -> Column:
    """Dates written ``2024-02-29`` or ``2/29/2024``."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("M/d/yyyy"))).cast("date")


def client_config(
    form: DataFrame,
    prospect_schema: str,
    rows_per_client: DataFrame | None = None,
    lists: Sequence[str] = ("brands_display", "special_attribute_column"),
) -> DataFrame:
    """Newest submission per client with parsed dates, lists and package switches.

    A submission without packages buys all of them. ``rows_per_client`` adds what an earlier run knew.
    """
    stamped = form.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(TIMESTAMP_FORMAT)))
    others = [c for c in stamped.columns if c not in ("demo_name", "timestamp")]
    newest = latest_by(stamped, ["demo_name"], ["timestamp"], others)
    chosen = F.transform(F.split("packages", ","), lambda x: F.trim(x))
    typed = newest.withColumns(
        {
            "start_date_of_data": any_date(F.col("start_date_of_data")),
            "is_prospect": F.col("prod_schema") == prospect_schema,
            **{c: list_text(F.col(c)) for c in lists if c in newest.columns},
            **{flag: F.coalesce(F.array_contains(chosen, label), F.lit(True)) for flag, label in PACKAGES.items()},
        }
    )
    return typed if rows_per_client is None else typed.join(rows_per_client, "demo_name", "left")
