from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplan.llm.mixing import mix_sources, period


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_shares_never_deviate_by_a_block(weights):
    slots = period(weights)
    total = sum(map(len, slots))
    assert sorted(s for own in slots for s in own) == list(range(total))
    for weight, own in zip(weights, slots):
        share = Fraction(weight, sum(weights))
        for slot in range(total):
            lag = share * (slot + 1) - sum(s <= slot for s in own)
            assert -1 < lag < 1


@pytest.fixture
def sizes(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(300)] + [(1000, None, 50), (1001, "empty", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mix(spark, sizes):
    targets = spark.createDataFrame([("m", "big", 60, 1, 50), ("m", "small", 30, 3, 50), ("m", "gone", 10, 5, 50), ("tight", "small", 100, 1, 100), ("tight", "empty", 0, 2, 100)], "mix_id string, source string, target_percent int, max_repeats int, size_percent int")
    drawn, shares = mix_sources(sizes, targets, block_tokens=40, buckets=5)
    drawn, shares = drawn.toPandas(), shares.toPandas().set_index(["mix_id", "source"])
    total = sizes.toPandas().n_tokens.sum()
    per_source = sizes.toPandas().groupby("source").n_tokens.sum()
    for (mix, source), row in shares.iterrows():
        own = drawn[(drawn.mix_id == mix) & (drawn.source == source)]
        assert own.n_tokens.sum() == row.drawn_tokens
        if row.short:
            repeats = targets.toPandas().set_index(["mix_id", "source"]).max_repeats[mix, source]
            assert row.drawn_tokens == per_source.get(source, 0) * repeats < row.target_tokens
        else:
            assert 0 <= row.drawn_tokens - row.target_tokens < 17
    assert shares.loc[("m", "gone")].short and shares.loc[("tight", "small")].short and not shares.loc[("m", "big")].short
    assert shares.loc[("m", "big")].target_tokens == pytest.approx(total * 0.3)
    # Offsets of a source follow each other without holes, pass after pass.
    own = drawn[(drawn.mix_id == "m") & (drawn.source == "small")].sort_values("offset")
    assert (own.offset + own.n_tokens).iloc[:-1].tolist() == own.offset.iloc[1:].tolist()
    assert own.slot.is_monotonic_increasing
    # No slot belongs to two sources.
    assert (drawn.groupby(["mix_id", "slot"]).source.nunique() == 1).all()


def test_skew_and_repeats_of_rows(spark):
    rows = [(1, "s", 5)] * 10 + [(2, "s", 0)] * 3
    drawn, shares = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), spark.createDataFrame([("m", "s", 100, 2, 150)], "mix_id string, source string, target_percent int, max_repeats int, size_percent int"), block_tokens=7, buckets=3)
    assert shares.first()["drawn_tokens"] == 75 and not shares.first()["short"]
    assert drawn.filter("n_tokens > 0").count() == 15


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 100, 1, 100)], "mix_id string, source string, target_percent int, max_repeats int, size_percent int")
    drawn, shares = mix_sources(documents, targets)
    assert drawn.count() == 0 and not shares.first()["short"]
    drawn, shares = mix_sources(documents, targets.limit(0))
    assert drawn.count() == shares.count() == 0


def test_found_matches_arithmetic(spark, data):
    from lodeplan.llm.queries import p8_found
    from lodeplan.llm.tokens import measured

    documents = measured(spark.read.parquet(f"{data}/documents.parquet"), doc_id="doc_id", text="text", keep=["source"]).toPandas()
    have, total = documents.groupby("source").n_tokens.sum(), documents.n_tokens.sum()
    targets = spark.read.parquet(f"{data}/mix_targets.parquet").toPandas()
    want = {(t.mix_id, t.source) for t in targets.itertuples() if int(have.get(t.source, 0)) * t.max_repeats * 10000 < t.target_percent * t.size_percent * int(total)}
    assert {tuple(r) for r in p8_found(spark, data).collect()} == want
    assert isinstance(documents, pd.DataFrame)


def test_dirty_targets_and_clashing_columns(spark, sizes):
    names = "mix_id string, source string, target_percent int, max_repeats int, size_percent int, have long, slot int, need int"
    targets = spark.createDataFrame([("m", "big", 50, 1, 10, 1, 1, 1)] * 2 + [("m", "small", None, 1, 10, 1, 1, 1), (None, "big", 50, 1, 10, 1, 1, 1), ("m", None, 50, 1, 10, 1, 1, 1), ("m", "empty", 50, 2, 10, 1, 1, 1)], names)
    drawn, shares = mix_sources(sizes.selectExpr("*", "1 as start", "2 as bucket", "3 as mix_id"), targets, block_tokens=40, buckets=5)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "empty"} and not got["big"].short and got["empty"].short and not got["small"].short
    assert got["small"].drawn_tokens == 0 and drawn.filter("source = 'big'").groupBy("doc_id").count().filter("count > 1").count() == 0
