"""Writing, publishing and copying tables. These run Spark jobs; the operators do not."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.operators.publish import changes_applied
from aislewise.operators.quality import standardize_attributes, validate_attributes
from aislewise.operators.schema import next_version, release_of, repair_null_types, schema_change


def table_name(schema: str, name: str) -> str:
    return f"{schema}.{name}"


def write_table(
    df: DataFrame,
    schema: str,
    name: str,
    overwrite: bool = True,
    variant_columns: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> str:
    """Write a parquet table after repairing untyped columns.

    An existing table is not replaced unless ``overwrite`` is set. ``partition_by`` and ``bucket_by`` lay
    a large item base out for its readers: months for pruning, users or products for joins.
    """
    full = table_name(schema, name)
    writer = repair_null_types(df, variant_columns).write.format("parquet").mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        count, columns = bucket_by
        writer = writer.bucketBy(count, *columns).sortBy(*columns)
    writer.saveAsTable(full)
    return full


def warehouse_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the session's warehouse, which driver and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def copy_files(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write a frame to its own folder in the warehouse and return the copy; 0 sets no bound on the rows of a file."""
    path = warehouse_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.parquet(path)


def stamped(df: DataFrame) -> DataFrame:
    """Add the audit column every published table carries."""
    return df.withColumn("_updated_timestamp", F.current_timestamp())


def set_provenance(spark: SparkSession, full_name: str, version: str, commit: str) -> None:
    """Record the code version and commit that built a table."""
    spark.sql(
        f"ALTER TABLE {full_name} SET TBLPROPERTIES ("
        "'build.version' = :version, 'build.commit' = :commit)".replace(":version", _quoted(version)).replace(
            ":commit", _quoted(commit)
        )
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def provenance(spark: SparkSession, full_name: str) -> dict[str, str | None]:
    """Version and commit of a table; both None for a table built by hand."""
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {full_name}").collect()}
    return {"version": properties.get("build.version"), "commit": properties.get("build.commit")}


def provenance_differences(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """``(property, values, tables_without)``: build properties in which some tables differ.

    One row per property with its distinct values and the tables that lack it; tables built from one commit
    of one version give no row.
    """
    found = [(name, key, value) for name in tables for key, value in provenance(spark, name).items()]
    rows = spark.createDataFrame(found, "name string, property string, value string")
    return (
        rows.groupBy("property")
        .agg(
            F.array_sort(F.collect_set("value")).alias("values"),
            F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("name")))).alias("tables_without"),
        )
        .where((F.size("values") > 1) | (F.size("tables_without") > 0))
    )


def publish_view(spark: SparkSession, view: str, full_name: str) -> None:
    """Point a view at the newest version of a table."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM {full_name}")


def publish_temp_view(df: DataFrame, view: str) -> None:
    df.createOrReplaceTempView(view)


def create_as_select(spark: SparkSession, full_name: str, query: str) -> None:
    """Materialise a query as a table."""
    spark.sql(f"CREATE TABLE {full_name} USING parquet AS {query}")


def publish_version(df: DataFrame, schema: str, name: str, variant_columns: Sequence[str] = ()) -> str:
    """Write the next release of a table beside the former ones, then move its view to it.

    The version grows when a column was dropped or retyped; any other release is a new revision of its
    version. The table that the view shows is never written to, so readers see no gap and ``df`` may read it.
    Former tables stay until someone drops them.
    """
    spark = df.sparkSession
    prefix = f"{name.lower()}__v"
    former = sorted((release_of(t.name)[1:], t.name) for t in spark.catalog.listTables(schema) if t.name.startswith(prefix))
    repaired = repair_null_types(df, variant_columns)
    target, revision = next_version(name, "same"), 0
    if former:
        (version, last), newest = former[-1]
        kind, _ = schema_change(spark.table(table_name(schema, newest)).schema, repaired.schema)
        target = next_version(newest, kind)
        revision = last + 1 if release_of(target)[1] == version else 0
    full = write_table(repaired, schema, f"{target}_r{revision:04d}")
    publish_view(spark, table_name(schema, name), full)
    return full


def append_release(df: DataFrame, schema: str, name: str) -> None:
    """Append rows of :func:`aislewise.operators.publish.pit_rows` to the release history."""
    df.write.format("parquet").mode("append").saveAsTable(table_name(schema, name))


def append_changes(changes: DataFrame, schema: str, name: str, keys: Sequence[str], buckets: int) -> str:
    """Append a change set to its table, in buckets of the keys as the batch table has them."""
    full = table_name(schema, name)
    changes.write.format("parquet").mode("append").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(full)
    return full


def compact_changes(spark: SparkSession, schema: str, base: str, changes: str, keys: Sequence[str], buckets: int, name: str) -> str:
    """Write the batch table that the change sets make of ``base`` as ``name``, in the same buckets.

    The former table and its change sets stay whole until the new one is complete.
    """
    made = changes_applied(spark.table(table_name(schema, base)), spark.table(table_name(schema, changes)), keys)
    return write_table(made, schema, name, bucket_by=(buckets, keys))


def copy_table(spark: SparkSession, source: str, schema: str, name: str) -> dict[str, object]:
    """Copy a table and compare the row counts of both."""
    target = write_table(spark.table(source), schema, name)
    counts = {"source_rows": spark.table(source).count(), "target_rows": spark.table(target).count()}
    return {**counts, "match": counts["source_rows"] == counts["target_rows"]}


def standardize_tables(
    spark: SparkSession,
    schemas: Sequence[str],
    table_like: str,
    columns: Sequence[str],
    replacement: str = "N/A",
    dry_run: bool = True,
) -> DataFrame:
    """Fill missing attributes in every table whose name matches ``table_like`` (``*`` is a wildcard).

    Fixed copies are written next to the source as ``<name>_standardized``, so a failed run leaves the
    source whole. A dry run only reports what would be done.
    """
    rows = []
    for schema in schemas:
        for table in spark.catalog.listTables(schema):
            if table.tableType == "VIEW" or not fnmatchcase(table.name, table_like.lower()):
                continue
            full = table_name(schema, table.name)
            df = spark.table(full)
            present = [c for c in columns if c in df.columns]
            if not present:
                rows.append((full, "", "NO_COLUMNS", None))
                continue
            missing = validate_attributes(df, present).agg(F.sum("null_count")).first()[0]
            if dry_run:
                status = "WOULD_UPDATE" if missing else "CLEAN"
            else:
                write_table(standardize_attributes(df, present, replacement), schema, f"{table.name}_standardized")
                status = "UPDATED"
            rows.append((full, ",".join(present), status, missing))
    return spark.createDataFrame(rows, "table_name string, columns string, status string, null_count bigint")
