"""Every query with SQL equals it in a second engine; the others return rows."""

import pytest

from conftest import SF, same_rows
from fuzzcurve.plans import queries as q

ROWS_ONLY = sorted(set(q.QUERIES) - set(q.ORACLES))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(q.QUERIES[name](spark, SF), duck.execute(q.ORACLES[name]).df())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
