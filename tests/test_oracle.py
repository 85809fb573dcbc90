import pytest

from lodeplan.queries import metrics, problem_sql, problems
from tests.oracle import compare, connect

QUERIES, SQL = problems.QUERIES | metrics.QUERIES, problem_sql.SQL | metrics.SQL


@pytest.fixture(scope="module")
def connection(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, connection, name):
    compare(spark, connection, data, QUERIES[name], SQL[name])


def test_ledger_counts(spark, data):
    for row in problems.p6_superseded(spark, data).collect():
        assert 0 <= row.n_superseded < row.n_rows


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["month", "region_at_order", "revenue_usd"]
