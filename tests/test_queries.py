"""Every query with SQL gives DuckDB's rows; every query runs on empty tables."""

from __future__ import annotations

import pytest

from tests.conftest import SF, TABLES, collected, duck
from tidelog.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, name):
    got = collected(registry.QUERIES[name](spark, SF))
    assert len(got) > 1 or name in ("heartbeat_gaps",)
    if name in registry.ORACLE_SQL:
        assert got == duck(registry.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("nothing")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    registry.QUERIES[name](spark, nothing).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
