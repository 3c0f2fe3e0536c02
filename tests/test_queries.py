"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["dia", "casados", "novos", "ambiguos"]
