"""Every registered query, against its SQL twin where there is one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import database, differences

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
