"""Queries of the subpackage on the smallest tables, against SQL where there is some."""

import pytest

from papergrid.llm import queries
from tests.oracle import DATA, rows, run_sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if sql := queries.SQL.get(name):
        assert rows(got) == rows(run_sql(sql))
