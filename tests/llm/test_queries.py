import pytest

from lodeplan.llm.queries import QUERIES
from lodeplan.llm.query_sql import SQL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    compare(spark, connect(data), data, QUERIES[name], SQL[name])


def test_fill_is_close_to_the_least_number_of_containers(spark, data):
    got = QUERIES["p7_fill"](spark, data).first()
    assert got.n_containers <= -(-got.tokens // 2048) + 1 and got.n_containers * 2048 - got.tokens == got.unused
    assert got.n_full > 0.8 * got.n_containers


def test_shares_are_those_drawn(spark, data):
    shares = QUERIES["p8_shares"](spark, data).toPandas()
    drawn = QUERIES["p8_drawn"](spark, data).toPandas().groupby(["mix_id", "source"]).n_tokens.sum()
    for row in shares.itertuples():
        assert drawn.get((row.mix_id, row.source), 0) == row.drawn_tokens
    assert shares.groupby("mix_id").actual_percent.sum().between(99.9, 100.1).all()


def test_pieces_begin_at_natural_boundaries(spark, data):
    kinds = {r.begins_at: r.n for r in QUERIES["p9_boundaries"](spark, data).collect()}
    assert kinds.get("token", 0) < 0.5 * sum(n for k, n in kinds.items() if k not in ("whole", "start"))
