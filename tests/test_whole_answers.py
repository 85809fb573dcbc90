"""Requests that are answered as a whole or not at all."""

from dataclasses import replace

from lodeplan.plans import demo
from lodeplan.plans.answers import prepare
from lodeplan.plans.binding import MAX_ROWS, Request
from tests.test_governed import Q2, ask, resolver

BY_REGION = Request(("commerce.order_count",), ("customer.region_at_order",), **Q2)


def _regions(n):
    """One order each of n customers who live in n regions."""
    history = [("T", i, "2020-01-01", None, f"region {i}", 0, 0) for i in range(n)]
    return {"orders": [("T", i, i, "2026-04-15T10:00", 1, "completed", 0, "none") for i in range(n)], "history": history}


def test_more_groups_than_the_cap_are_refused(spark):
    got = ask(spark, BY_REGION, **_regions(MAX_ROWS + 1))
    assert (got.status, got.reason, got.rows) == ("blocked", "RESULT_CONTRACT_BREACH", []) and f"more than {MAX_ROWS}" in got.notes[0]
    _, df, _ = prepare(demo.catalog(), demo.policy("T"), "full_T", BY_REGION, resolver(spark, **_regions(MAX_ROWS + 1)))
    assert df.count() == MAX_ROWS + 1


def test_up_to_the_cap_and_stated_limits_are_answered(spark):
    got = ask(spark, BY_REGION, **_regions(MAX_ROWS))
    assert got.status == "answered" and len(got.rows) == MAX_ROWS
    got = ask(spark, replace(BY_REGION, limit=7), **_regions(MAX_ROWS + 1))
    assert got.status == "answered" and len(got.rows) == 7
