import pytest

from cairnfield.llm import queries as q
from tests.conftest import DATA
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(q.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    compare(spark, con, q.QUERIES[name], q.ORACLES[name], DATA)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))
