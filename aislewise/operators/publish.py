"""Release operators: changes between releases and point-in-time history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.functions.periods import moment


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """128 bits of the row content. Missing values are told apart from empty texts."""
    parts = []
    for c in columns:
        value = F.to_json(c) if isinstance(df.schema[c].dataType, T.VariantType) else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), value), F.lit("n")))
    return F.md5(F.to_json(F.array(*parts)))


def changes_table(previous: DataFrame, current: DataFrame, keys: Sequence[str], released_at=None) -> DataFrame:
    """Rows inserted, updated or deleted since the last release, by primary key.

    Deleted rows carry their last released content. Unchanged rows are compared by digest and dropped.
    """
    columns = [c for c in current.columns if c in previous.columns and c not in keys]
    rest = [c for c in current.columns if c not in keys]
    old = previous.select(*keys, F.struct(*[F.col(c) for c in columns]).alias("__old"), _digest(previous, columns).alias("__old_digest"))
    new = current.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("__new"), _digest(current, columns).alias("__new_digest"))
    status = (
        F.when(F.col("__old_digest").isNull(), "INSERT")
        .when(F.col("__new_digest").isNull(), "DELETE")
        .when(F.col("__old_digest") != F.col("__new_digest"), "UPDATE")
    )
    joined = old.join(new, list(keys), "full_outer").withColumn("record_status", status)
    content = [
        (F.coalesce(F.col(f"__new.{c}"), F.when(F.col("__new").isNull(), F.col(f"__old.{c}"))) if c in columns else F.col(f"__new.{c}")).alias(c)
        for c in rest
    ]
    stamp = F.current_timestamp() if released_at is None else moment(released_at)
    return joined.filter(F.col("record_status").isNotNull()).select(
        *keys, *content, "record_status", stamp.alias("record_status_timestamp")
    )


def changes_applied(base: DataFrame, changes: DataFrame, keys: Sequence[str], stamp: str = "record_status_timestamp") -> DataFrame:
    """The release that ``changes``, rows of any number of :func:`changes_table` results, make of ``base``.

    Of a key's changes the newest wins; one that deletes leaves no row (a later insert brings the key back).
    Columns are those of the base; a column the changes lack keeps its value. Keys are not null, as in
    :func:`changes_table`. With base and changes bucketed
    alike by the keys nothing is shuffled: the changes are reduced, and met by the base, within buckets.
    """
    rest = [c for c in base.columns if c not in keys]
    content = F.struct("record_status", *[F.col(c) for c in rest if c in changes.columns])
    newest = changes.groupBy(*keys).agg(F.max_by(content, F.col(stamp)).alias("__new"))
    met = base.join(newest, list(keys), "full_outer")
    touched = F.col("__new").isNotNull()
    alive = F.coalesce(F.col("__new.record_status") != "DELETE", F.lit(True))
    new = lambda c: F.when(touched, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return met.where(alive).select(*(new(c) if c in rest and c in changes.columns else F.col(c) for c in base.columns))


def pit_rows(release: DataFrame, released_at, stamp: str = "publication_timestamp") -> DataFrame:
    """Rows of a release under its release time, ready to append to the history."""
    return release.withColumn(stamp, moment(released_at))


def pit_as_of(history: DataFrame, keys: Sequence[str], as_of, stamp: str = "publication_timestamp") -> DataFrame:
    """The newest version of each key released at or before ``as_of``."""
    known = history.filter(F.col(stamp) <= moment(as_of))
    rest = [c for c in history.columns if c not in (*keys, stamp)]
    newest = F.max_by(F.struct(stamp, *rest), F.col(stamp)).alias("__row")
    return known.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in (*rest, stamp)])


def release_as_of(history: DataFrame, as_of, stamp: str = "publication_timestamp") -> DataFrame:
    """The whole release that was current at ``as_of``: rows dropped by it do not come back."""
    known = history.filter(F.col(stamp) <= moment(as_of))
    return known.filter(F.col(stamp) == known.agg(F.max(stamp)).scalar())


def numbered_versions(history: DataFrame, keys: Sequence[str], stamp: str = "publication_timestamp") -> DataFrame:
    """Versions of each key numbered from its first release; a key has one row per release."""
    return history.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(stamp)))
