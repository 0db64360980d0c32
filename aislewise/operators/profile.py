"""Null shares of a large table from some of its files, with an error bound that holds for clustered nulls."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen_files(files: Sequence[str], fraction: float, seed: int = 7) -> list[str]:
    """Share ``fraction`` of the files, at least one, by a hash of their names: the same ones on every run."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    ranked = sorted(files, key=lambda name: hashlib.md5(f"{seed}|{name}".encode()).hexdigest())
    return ranked[: math.ceil(fraction * len(ranked))]


def sampled_profile(
    table: DataFrame, fraction: float, columns: Sequence[str] | None = None, miss: float = 0.05, seed: int = 7
) -> DataFrame:
    """Estimated share of nulls per column of a Parquet ``table``, and the most it can be off.

    ``DataFrame.sample`` reads every row before it drops most of them. Here only the chosen files are read,
    and of those only the columns asked for; of all other files only the row counts in their footers are.

    Rows of one file resemble each other, so files, not rows, are the units of the sample. ``error_bound`` is
    the Hoeffding-Serfling bound for drawing files without replacement, a file holding between no nulls and
    as many as the longest file has rows. It assumes nothing about where nulls lie, and holds for all columns
    at once but for a chance of ``miss``. With all files chosen the shares are exact and the bound is zero.

    Returns column, files, files_read, table_rows, null_share, error_bound. A table without rows has NULL
    shares and bounds. ``table`` is a plain read of files whose columns all lie in the files; only file names reach the driver.
    """
    names = list(columns if columns is not None else table.columns)
    files = table.inputFiles()
    picked = chosen_files(files, fraction, seed)
    total, read = len(files), len(picked)
    counted = table.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__rows"))
    size = counted.agg(F.struct(F.sum("__rows").alias("rows"), F.max("__rows").alias("longest"))).scalar()
    part = table.sparkSession.read.schema(table.schema).parquet(*picked) if picked else table
    nulls = part.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__null_{i}") for i, c in enumerate(names)])
    found = nulls.withColumn("__size", size)
    rows, longest = F.col("__size.rows"), F.col("__size.longest")
    if 0 < read < total:
        spread = math.sqrt((1 - (read - 1) / total) * math.log(2 * len(names) / miss) / (2 * read))
        bound = F.least(F.lit(1.0), F.lit(spread * total) * longest / rows)
    else:
        bound = F.lit(0.0)
    shown = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(total).alias("files"),
            F.lit(read).alias("files_read"),
            F.coalesce(rows, F.lit(0)).alias("table_rows"),
            F.when(rows > 0, F.least(F.lit(1.0), F.col(f"__null_{i}") * F.lit(total / max(read, 1)) / rows)).alias("null_share"),
            F.when(rows > 0, bound).alias("error_bound"),
        )
        for i, c in enumerate(names)
    ]
    return found.select(F.inline(F.array(*shown)))
