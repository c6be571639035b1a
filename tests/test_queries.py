"""Every query of the library beside its SQL on the smallest tables."""

import os

import pytest

from corvane.plans import catalogue
from tests.compare import compare, oracle

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, said = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, said


def test_entry_needs_no_training_operators():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
