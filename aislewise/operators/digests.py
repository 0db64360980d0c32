"""Comparing large tables by digests, so that equal parts are never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.compare import multiset_difference

# The digest table has one row per bucket and is broadcast; more buckets than this are refused.
MAX_BUCKETS = 1 << 18


def _alike(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with their common columns, cast to the types a union of them has."""
    columns = sorted(set(first.columns) & set(second.columns))
    if not columns:
        raise ValueError("the tables have no column in common")
    types = {f.name: f.dataType for f in first.select(*columns).unionByName(second.select(*columns)).schema.fields}
    cast = [F.col(c).cast(types[c]).alias(c) for c in columns]
    return first.select(*cast), second.select(*cast), columns


def _hash(columns: Sequence[str], salt: int) -> Column:
    """64-bit hash in which NULL has a place of its own; Spark's hash alone passes over NULL."""
    return F.xxhash64(F.lit(salt), *[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(_hash(keys, 0), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, keys: Sequence[str], buckets: int = 4096, columns: Sequence[str] | None = None) -> DataFrame:
    """``(bucket, n_rows, digest_a, digest_b)`` of every bucket of the keys that has rows.

    The digests are sums of two hashes of whole rows: they do not depend on the order of rows, and copies count
    (an exclusive or would lose every second one). Sums combine before the shuffle, so it moves at most one
    row per bucket and task, however many rows share a key.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    whole = list(columns or df.columns)
    sums = [F.sum(_hash(whole, salt).cast("decimal(20,0)")).alias(f"digest_{name}") for name, salt in (("a", 1), ("b", 2))]
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def compare_digests(first: DataFrame, second: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """``(bucket, rows_first, rows_second, same)`` for every bucket that has rows on a side."""
    a, b, columns = _alike(first, second)
    left = bucket_digests(a, keys, buckets, columns).select("bucket", F.struct("n_rows", "digest_a", "digest_b").alias("__a"))
    right = bucket_digests(b, keys, buckets, columns).select("bucket", F.struct("n_rows", "digest_a", "digest_b").alias("__b"))
    zero = F.lit(0).cast("bigint")
    return left.join(right, "bucket", "full_outer").select(
        "bucket",
        F.coalesce("__a.n_rows", zero).alias("rows_first"),
        F.coalesce("__b.n_rows", zero).alias("rows_second"),
        F.col("__a").eqNullSafe(F.col("__b")).alias("same"),
    )


def compare_buckets(first: DataFrame, second: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Surplus rows of both sides with ``side`` and ``surplus``, as :func:`multiset_difference` gives them.

    Both tables are read twice, but only rows of buckets whose digests differ are shuffled and compared row by
    row: releases that differ in a few keys move a few buckets, equal ones none. Columns of one table only are
    left out, other types are brought to a common one. Rows without a key are a key. Two different buckets pass
    for equal only if both 64-bit sums and the row counts agree by chance. Tables without rows give no row.
    """
    a, b, _ = _alike(first, second)
    differing = compare_digests(a, b, keys, buckets).filter(~F.col("same")).select(F.col("bucket").alias("__bucket"))
    # At most MAX_BUCKETS rows of one number.
    small = F.broadcast(differing)
    kept = [df.join(small, _bucket(keys, buckets) == F.col("__bucket"), "left_semi") for df in (a, b)]
    return multiset_difference(*kept)
