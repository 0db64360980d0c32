"""Named table lookup: parquet folders or a metastore schema behind one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``Tables(spark, folder=...)("orders")`` reads ``folder/orders.parquet``;
    ``Tables(spark, schema="gold", prefix="demo_")("sku_analysis")`` reads ``gold.demo_sku_analysis``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, schema: str | None = None, prefix: str = ""):
        if (folder is None) == (schema is None):
            raise ValueError("give either a parquet folder or a metastore schema")
        self.spark = spark
        self.folder = folder
        self.schema = schema
        self.prefix = prefix

    def __call__(self, name: str) -> DataFrame:
        if self.folder is not None:
            return self.spark.read.parquet(f"{self.folder}/{self.prefix}{name}.parquet")
        return self.spark.table(f"{self.schema}.{self.prefix}{name}")
