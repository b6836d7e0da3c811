"""Every query that SQL can express gives what the SQL gives; every other one runs and has a stable schema."""

import pytest

from calembour.plans import registry
from tests.conftest import SF
from tests.oracle import connect, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.schema == QUERIES[name](spark, SF).schema
    assert df.count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
