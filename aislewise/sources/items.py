"""The item base: one row per purchased item, the input of every mart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.labels import first_match
from aislewise.functions.periods import floor_to
from aislewise.sources.tables import Tables

# Optional item columns and the type they take when the source lacks them (fixed values).
OPTIONAL_TYPES = {
    "order_id": "bigint",
    "product_id": "string",
    "web_description": "string",
    "channel": "string",
    "source": "string",
    "age": "string",
    "gender": "string",
    "region": "string",
    "state": "string",
    "panel_end_date": "date",
    "product_hash": "string",
    "parent_sku": "string",
    "parent_sku_name": "string",
    "variation_sku": "string",
    "variation_sku_name": "string",
    "parent_brand": "string",
    "product_url": "string",
}

# Market segment of a buyer mapped to an age band (fixed values).
SEGMENT_AGES = (
    ("AUTOMOBILE", "18-24"),
    ("BUILDING", "25-34"),
    ("FURNITURE", "45-54"),
    ("HOUSEHOLD", "55-64"),
    ("MACHINERY", "65+"),
)


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _second_word() -> Column:
    return F.get(F.split("p_name", " "), F.lit(1))


def _panel(inside, outside) -> Column:
    return F.when(F.col("o_custkey") % 3 != 0, inside).otherwise(outside)


# Source column -> (dimension it comes from, expression).
_STAR: Mapping[str, tuple[str, object]] = {
    "order_date": ("orders", lambda: F.col("o_orderdate").cast("date")),
    "user_id": ("orders", lambda: F.col("o_custkey")),
    "order_id": ("lineitem", lambda: F.col("l_orderkey")),
    "line_number": ("lineitem", lambda: F.col("l_linenumber")),
    "sku": ("lineitem", lambda: F.col("l_partkey")),
    "web_description": ("part", lambda: F.when(F.col("l_partkey") % 50 != 0, F.col("p_name"))),
    "parent_brand": ("part", lambda: F.when(F.col("l_partkey") % 40 != 0, F.col("p_brand"))),
    "brand": ("part", lambda: F.col("p_brand")),
    "sub_brand": ("part", lambda: F.concat("p_brand", F.lit("-"), "p_type")),
    "type_name": ("part", lambda: F.col("p_type")),
    "noun": ("part", _second_word),
    "merchant": ("supplier", lambda: F.col("s_nation")),
    "merchant_clean": ("supplier", lambda: F.col("s_region")),
    "channel": ("lineitem", lambda: F.when(F.col("l_returnflag") == "N", "ONLINE").otherwise("B&M")),
    "state": ("customer", lambda: F.col("c_nation")),
    "region": ("customer", lambda: F.col("c_region")),
    "source": ("orders", lambda: _panel("panel_a", "panel_b")),
    "panel_flag": ("orders", lambda: _panel(1, 0)),
    "age": ("customer", lambda: first_match([(F.col("c_mktsegment") == s, a) for s, a in SEGMENT_AGES])),
    "item_quantity": ("lineitem", lambda: F.col("l_quantity").cast("decimal(12,2)")),
    "item_price": (
        "lineitem",
        lambda: F.round(F.try_divide(_price(), F.col("l_quantity").cast("decimal(12,2)")), 2).cast("decimal(18,2)"),
    ),
    "gmv": (
        "lineitem",
        lambda: (_price() * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)"),
    ),
    "finish": (
        "part",
        lambda: F.when(F.col("p_size") == 1, None)
        .when(F.col("p_size") <= 15, "S")
        .when(F.col("p_size") <= 35, "M")
        .otherwise("L"),
    ),
    "product_attributes": (
        "part",
        lambda: F.when(F.col("l_partkey") % 7 != 0, F.parse_json(F.to_json(F.struct("p_size", "p_type")))),
    ),
}

# Derived item column -> source columns it needs.
_NEEDS = {
    "month": ("order_date",),
    "year": ("order_date",),
    "product_id": ("sku",),
    "major_cat": ("type_name",),
    "sub_cat": ("noun",),
    "minor_cat": ("noun",),
}

ITEM_COLUMNS = (
    "order_date", "month", "year", "user_id", "order_id", "line_number", "sku", "product_id", "web_description",
    "parent_brand", "brand", "sub_brand", "major_cat", "sub_cat", "minor_cat", "merchant", "merchant_clean",
    "channel", "state", "region", "source", "panel_flag", "age", "item_quantity", "item_price", "gmv", "finish",
    "product_attributes",
)


def _located(df: DataFrame, tables: Tables, prefix: str) -> DataFrame:
    """Add nation and region names for the ``<prefix>_nationkey`` column.

    The two tables are joined one by one to ``df``: each is a plain scan whose size Spark knows exactly,
    so both broadcast, which an estimate over a pre-joined dimension would prevent.
    """
    return (
        df.join(tables("nation"), F.col(f"{prefix}_nationkey") == F.col("n_nationkey"), "left")
        .join(tables("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .withColumnsRenamed({"n_name": f"{prefix}_nation", "r_name": f"{prefix}_region"})
        .drop("n_nationkey", "n_regionkey", "r_regionkey")
    )


def source_items(
    tables: Tables, columns: Iterable[str] | None = None, since: dt.date | str | None = None, lots: int | None = None
) -> DataFrame:
    """Source items of the star schema with the columns asked for.

    Dimensions are left-joined on their primary key, so leaving one out cannot change the number of
    rows: a caller that needs no supplier column does not pay for the supplier shuffle. Which joins
    broadcast is left to Spark, which knows the size of each side. Orders before ``since`` are skipped while
    they are read; their items keep no date, and the start-date cut of the item base drops them.

    The texts of products are the widest columns and are joined last, so that no other join moves them. With ``lots``
    items are dealt by product in so many lots before that: later groupings by product need no shuffle of these texts either.
    """
    wanted = list(dict.fromkeys(columns if columns is not None else _STAR))
    used = {_STAR[c][0] for c in wanted}
    items = tables("lineitem")
    if used & {"orders", "customer"}:
        orders = tables("orders")
        if since is not None:
            # On the stored column, so that the parquet statistics can rule row groups out.
            orders = orders.filter(F.col("o_orderdate") >= F.lit(str(since)).cast(orders.schema["o_orderdate"].dataType))
        if "customer" in used:
            orders = orders.join(tables("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
            orders = _located(orders, tables, "c")
        items = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "supplier" in used:
        items = items.join(tables("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        items = _located(items, tables, "s")
    if lots is not None:
        items = items.repartition(lots, "l_partkey")
    if "part" in used:
        items = items.join(tables("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return items.select(*[_STAR[c][1]().alias(c) for c in wanted])


def prep_filter_items(
    source: DataFrame,
    category_cols: Sequence[str],
    start_date: dt.date | str | None = None,
    special_attributes: Sequence[str] = (),
    product_id: str = "sku",
) -> DataFrame:
    """Turn source items into the item base.

    Up to three category columns become major, sub and minor category (a missing level repeats the one
    above), rows before ``start_date`` are cut, month and year are derived, and special attributes are
    carried as text. Columns the source does not have are skipped.
    """
    have = set(source.columns)
    added: dict[str, Column] = {}
    if "order_date" in have:
        if start_date is not None:
            source = source.filter(F.col("order_date") >= F.lit(start_date).cast("date"))
        added["month"] = floor_to("month", F.col("order_date"))
        added["year"] = floor_to("year", F.col("order_date"))
    levels = [c for c in category_cols]
    levels += [levels[-1]] * (3 - len(levels)) if levels else []
    for name, column in zip(("major_cat", "sub_cat", "minor_cat"), levels):
        if column in have:
            added[name] = F.col(column)
    if product_id in have:
        added["product_id"] = F.col(product_id)
    for name in special_attributes:
        if name in have:
            added[name] = F.col(name).cast("string")
    return source.withColumns(added)


def filter_items(
    tables: Tables,
    columns: Iterable[str] | None = None,
    start_date: dt.date | str | None = None,
    lots: int | None = None,
) -> DataFrame:
    """Item base of the star schema, restricted to ``columns`` before any join is planned.

    With ``lots`` its rows come dealt by ``sku`` and ``product_id`` in so many lots.
    """
    wanted = list(dict.fromkeys(columns if columns is not None else ITEM_COLUMNS))
    needed = [n for c in wanted for n in _NEEDS.get(c, (c,))]
    if start_date is not None:
        needed.append("order_date")
    source = source_items(tables, needed, start_date, lots)
    base = prep_filter_items(source, ("type_name", "noun", "noun"), start_date, ("finish",), "sku")
    return base.select(*wanted)


def with_optional(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add each missing optional column as a typed NULL."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(OPTIONAL_TYPES.get(c, "string")) for c in missing})
