"""Every query of the core runs on the smallest tables; those with SQL give the same rows and columns."""

import pytest

from papergrid.plans import catalog
from tests.oracle import DATA, rows, run_sql

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if sql := catalog.SQL.get(name):
        want = run_sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
