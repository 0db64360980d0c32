"""Null shares from some files against all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aislewise.operators.profile import chosen_files, sampled_profile


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """4000 rows in 40 files of equal length; nulls of ``late`` fill the last quarter of the files."""
    rows = spark.range(4000).select(
        "id",
        F.when(F.col("id") < 3000, F.col("id")).alias("late"),
        F.when(F.col("id") % 10 != 0, F.col("id")).alias("spread"),
        F.lit(None).cast("string").alias("never"),
        F.col("id").alias("a.b"),
    )
    path = str(tmp_path_factory.mktemp("profile") / "table")
    rows.repartitionByRange(40, "id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("seed", range(6))
def test_bound_holds_for_clustered_nulls(table, seed):
    true = {"id": 0.0, "late": 0.25, "spread": 0.1, "never": 1.0, "a.b": 0.0}
    for r in sampled_profile(table, 0.5, seed=seed).collect():
        assert r.files_read == (r.files + 1) // 2 and r.table_rows == 4000
        assert 0 < r.error_bound < 0.5
        assert abs(r.null_share - true[r.column]) <= r.error_bound


def test_estimates_differ_between_samples_but_not_between_runs(table):
    def late(seed):
        return sampled_profile(table, 0.3, ["late"], seed=seed).first().null_share

    assert late(1) == late(1)
    assert len({late(seed) for seed in range(8)}) > 1


def test_all_files_are_exact(table):
    found = {r.column: (r.null_share, r.error_bound) for r in sampled_profile(table, 1.0).collect()}
    assert found["late"] == (0.25, 0.0) and found["spread"] == (0.1, 0.0) and found["never"] == (1.0, 0.0)


def test_reads_only_the_chosen_files_and_columns(table):
    plan = sampled_profile(table, 0.1, ["late"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<late:bigint>" in plan and "ReadSchema: struct<>" in plan


def test_table_without_rows(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.range(0).write.parquet(path)
    rows = sampled_profile(spark.read.parquet(path), 0.5).collect()
    assert [(r.column, r.table_rows, r.null_share) for r in rows] == [("id", 0, None)]


def test_fraction_is_checked():
    assert chosen_files(["a", "b", "c"], 0.01) and chosen_files([], 0.5) == []
    for wrong in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            chosen_files(["a"], wrong)
