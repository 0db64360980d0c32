"""Variant columns as typed columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types that a column of one plain value can have; lists, objects and mixed types stay variant.
_PLAIN = re.compile(r"BIGINT|STRING|BOOLEAN|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\)")
# Keys become columns; an object with more is refused.
MAX_KEYS = 2000


def variant_keys(df: DataFrame, column: str) -> DataFrame:
    """``(key, type, n_rows)`` of the keys of all objects of a variant column, with the type that holds all values.

    Types merge inside the aggregate, so a key is one row per task before the shuffle. A key whose values
    have nothing in common has the type ``VARIANT``. Rows that hold no object have no keys.
    """
    objects = F.try_variant_get(column, "$", "map<string, variant>")
    pairs = df.select(F.explode(objects).alias("key", "value"))
    return pairs.groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("n_rows"))


def typed_columns(df: DataFrame, column: str, rest: str = "rest") -> DataFrame:
    """Replace a variant column by a typed column for every key that has one plain type, and ``rest``.

    ``rest`` is a variant with everything else: keys of mixed types, lists and objects, values that are an explicit null, and
    whole values that are no object; it is NULL if nothing is left. So typed columns and ``rest`` together hold what
    the column held. A key stays in ``rest`` if a column already has its name, or if two keys differ only in case.
    An object without keys is nothing. Reads the keys to the driver; more than ``MAX_KEYS`` are an error.
    """
    found = variant_keys(df, column).orderBy("key").limit(MAX_KEYS + 1).collect()
    if len(found) > MAX_KEYS:
        raise ValueError(f"{column} has more than {MAX_KEYS} keys")
    lowered = [r["key"].lower() for r in found]
    taken = {c.lower() for c in df.columns if c != column} | {rest.lower()}
    plain = {
        r["key"]: r["type"]
        for r in found
        if _PLAIN.fullmatch(r["type"]) and r["key"].lower() not in taken and lowered.count(r["key"].lower()) == 1
    }
    objects = F.try_variant_get(column, "$", "map<string, variant>")
    held = df.withColumn("__map", objects)
    values = [F.try_variant_get(F.try_element_at("__map", F.lit(k)), "$", t).alias(k) for k, t in plain.items()]
    left = F.map_filter("__map", lambda k, v: ~k.isin(list(plain)) | F.is_variant_null(v)) if plain else F.col("__map")
    remainder = F.when(F.col("__map").isNull(), F.col(column)).when(F.size(left) > 0, F.to_variant_object(left))
    others = [F.col(c) for c in df.columns if c != column]
    return held.select(*others, *values, remainder.alias(rest))
