"""Every registered query against its SQL on the sf0.01 tables."""

import pytest
from compare import duck, same

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    result = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert same(result, connection, oracle_sql()[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    result = entry(spark)
    assert result.count() > 0 and "severe_pairs" in result.columns


def test_registries_match():
    assert set(oracle_sql()) <= set(queries())
