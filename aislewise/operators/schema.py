"""Schema checks and schema versions. Metadata only; nothing here reads rows."""

from __future__ import annotations

import re

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted types of the item base (fixed values).
MANDATORY: Mapping[str, Sequence[str]] = {
    "order_date": ("date", "timestamp", "string"),
    "merchant": ("string",),
    "brand": ("string",),
    "item_price": ("double", "float", "decimal", "int", "bigint"),
    "item_quantity": ("int", "bigint", "double", "float"),
    "gmv": ("double", "float", "decimal"),
    "panel_flag": ("string", "boolean", "int"),
    "month": ("date", "string", "int"),
    "user_id": ("string", "bigint", "int"),
}
OPTIONAL: Mapping[str, Sequence[str]] = {
    "order_id": ("string", "bigint", "int"),
    "product_id": ("string", "bigint", "int"),
    "web_description": ("string",),
    "channel": ("string",),
    "source": ("string",),
    "year": ("date", "int", "string"),
    "factor_age": ("float", "string", "int"),
    "age": ("string", "int", "double"),
    "gender": ("string",),
    "region": ("string",),
    "state": ("string",),
    "panel_end_date": ("date", "timestamp", "string"),
    "full_price_estimate": ("double", "float", "decimal"),
    "category": ("string",),
    "subcategory": ("string",),
}
COLUMN_ORDER = (
    "order_date", "merchant", "month", "brand", "item_price", "item_quantity", "gmv", "panel_flag", "user_id",
)

_REPORT = "check string, column string, detail string, status string"


def _accepts(actual: str, accepted: Sequence[str]) -> bool:
    """``decimal(18,2)`` is accepted where ``decimal`` is listed."""
    return actual.split("(")[0] in accepted


def schema_report(
    df: DataFrame,
    mandatory: Mapping[str, Sequence[str]] = MANDATORY,
    optional: Mapping[str, Sequence[str]] = OPTIONAL,
    order: Sequence[str] = COLUMN_ORDER,
) -> DataFrame:
    """One row per finding: mandatory columns, types, optional coverage, order, undocumented columns."""
    actual = {f.name: f.dataType.simpleString().lower() for f in df.schema.fields}
    rows = []
    for c in mandatory:
        rows.append(("mandatory", c, actual.get(c, "missing"), "PASSED" if c in actual else "FAILED"))
    for c, accepted in {**mandatory, **optional}.items():
        if c in actual:
            ok = _accepts(actual[c], accepted)
            rows.append(("type", c, actual[c] if ok else f"{actual[c]}, expected {'/'.join(accepted)}", "PASSED" if ok else "FAILED"))
    for c in optional:
        rows.append(("optional", c, "present" if c in actual else "absent", "PASSED"))
    present = [c for c in order if c in actual]
    for wanted, c in enumerate(present):
        at = df.columns.index(c)
        rows.append(("order", c, f"position {at}, expected {wanted}", "PASSED" if at == wanted else "WARNING"))
    for c in df.columns:
        if c not in mandatory and c not in optional:
            rows.append(("undocumented", c, actual[c], "WARNING"))
    return df.sparkSession.createDataFrame(rows, _REPORT)


def schema_change(previous: T.StructType, current: T.StructType) -> tuple[str, list[tuple[str, str]]]:
    """Kind of change between two releases and the columns behind it.

    ``same``: identical. ``minor``: columns were only added at the end or moved. ``major``: a column was
    dropped or retyped, which readers of the old version cannot follow.
    """
    old = {f.name: f.dataType for f in previous.fields}
    new = {f.name: f.dataType for f in current.fields}
    changes = [(c, "dropped") for c in old if c not in new]
    changes += [(c, "retyped") for c in old if c in new and old[c] != new[c]]
    changes += [(c, "added") for c in new if c not in old]
    kept_old = [c for c in old if c in new]
    kept_new = [c for c in new if c in old]
    changes += [(a, "moved") for a, b in zip(kept_old, kept_new) if a != b]
    kinds = {k for _, k in changes}
    if not kinds:
        return "same", []
    return ("major" if kinds & {"dropped", "retyped"} else "minor"), changes


def next_version(name: str, kind: str) -> str:
    """Table name of the next release: the ``__vNNN`` number grows with every major change."""
    stem, version, _ = release_of(name)
    return f"{stem}__v{version + (kind == 'major'):03d}"


def release_of(name: str) -> tuple[str, int, int]:
    """Stem, version and revision of a table name; ``mart__v002_r0005`` is the sixth table of its third layout."""
    found = re.fullmatch(r"(.*?)(?:__v(\d+)(?:_r(\d+))?)?", name)
    return found[1], int(found[2] or 0), int(found[3] or 0)


def schema_change_report(previous: DataFrame, current: DataFrame) -> DataFrame:
    kind, changes = schema_change(previous.schema, current.schema)
    rows = [(c, k, kind) for c, k in changes] or [(None, "none", kind)]
    return current.sparkSession.createDataFrame(rows, "column string, change string, version_step string")


def repair_null_types(df: DataFrame, variant_columns: Sequence[str] = ()) -> DataFrame:
    """Give columns without a type one that can be written: variant where named so, text otherwise."""
    repaired = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NullType):
            missing = F.lit(None).cast("string")
            repaired[f.name] = F.parse_json(missing) if f.name in variant_columns else missing
    return df.withColumns(repaired)
