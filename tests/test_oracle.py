import pytest

from cairnfield import queries as q
from tests.conftest import DATA
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    compare(spark, con, q.QUERIES[name], q.ORACLES[name], DATA)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLES)
