"""Labelled training rows, of a bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled documents whose id is ``usable``.

    The rows with the smallest hash of their id are taken, so the choice does not depend on layout. A
    document labelled more than once counts as 1 if any label is 1; null ids and labels are left out. The
    side that is broadcast has at most ``max_rows`` rows of two numbers.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = (
        known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def remainder(n: int) -> Column:
    """CRC-32 of the id written as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n
