"""Every registered query against its SQL in DuckDB."""

import pytest

from compare import of_duckdb, of_spark
from lexframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duckdb(SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_both_as_of_joins_agree(spark, sf_dir):
    a, b = (of_spark(QUERIES[n](spark, sf_dir)) for n in ("j3_version_as_at", "j3_version_as_at_by_range"))
    assert a == b
