from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from aislewise.session import local_session

    os.environ.setdefault(
        "PYSPARK_SUBMIT_ARGS",
        f"--conf spark.sql.warehouse.dir={tempfile.mkdtemp(prefix='aislewise-warehouse-')} pyspark-shell",
    )
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    from aislewise.sources.tables import Tables

    return Tables(spark, folder=sf_dir)
