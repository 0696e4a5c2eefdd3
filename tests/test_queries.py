"""Every registered query against its check SQL."""

import pytest

from compare import connect, duckdb_rows, spark_rows
from footfall.plans.registry import ORACLE, QUERIES


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duckdb_rows(connect(small), ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r.step for r in rows] == [1, 2, 3] and rows[0].users > 0
