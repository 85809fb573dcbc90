"""The pending state batch by batch: buckets, compaction, deletions, replaced statements, snapshots."""

import random
from datetime import timezone

import pytest
from pyspark.sql import functions as F

from lodeplan.operators import orphans
from lodeplan.operators.orphans import OrphanTracker, key_index, snapshot_orphans
from tests.test_references import CHILD, KEY, at, expected, feed


@pytest.mark.parametrize("buckets, compact", [(5, 16), (5, 2), (1, 3)])
def test_every_batch_equals_a_full_pass(spark, monkeypatch, buckets, compact):
    monkeypatch.setattr(orphans, "COMPACT", compact)
    parents, children = feed(buckets + compact)
    p = spark.createDataFrame(parents, "row long, t string, k long, at timestamp, op string")
    c = spark.createDataFrame(children, "t string, k long, line int, at timestamp")
    state = OrphanTracker(KEY, CHILD, buckets=buckets)
    cuts = [at(h) for h in (0, 20, 21, 40, 60, 80, 200)]
    for low, high in zip(cuts, cuts[1:]):
        mine = lambda df: df.filter((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high)))  # noqa: B023, E731
        state = state.advance(mine(c), key_index(mine(p), key=KEY, at="at", row="row", gone=F.col("op") == "delete"))
        assert {(r.k, r.line, r.reason, r.at.replace(tzinfo=timezone.utc)) for r in state.report().collect()} == expected(parents, children, high)


def test_replaced_statements(spark):
    """A child's last statement counts, also where its reference had been settled and is deleted later."""
    c = lambda rows: spark.createDataFrame(rows, "t string, k long, line int, at timestamp")
    p = lambda rows: key_index(spark.createDataFrame(rows, "t string, k long, at timestamp, row long, gone boolean"), key=KEY, at="at", row="row", gone=F.col("gone"))
    child = ["t", "line"]
    none = c([]).select("t", "line")
    state = OrphanTracker(KEY, child, buckets=3).advance(c([("t", 1, 1, at(1)), ("t", 9, 2, at(1))]), p([("t", 1, at(0), 1, False)]), withdrawn=none)
    assert [(r.line, r.k, r.reason) for r in state.report().collect()] == [(2, 9, "missing")]
    state = state.advance(c([("t", 8, 1, at(2))]), p([]), withdrawn=c([("t", 8, 1, at(2)), ("t", None, 2, at(2))]).select("t", "line"))
    assert [(r.line, r.k, r.reason) for r in state.report().collect()] == [(1, 8, "missing")]
    state = state.advance(c([("t", 1, 3, at(3))]), p([("t", 1, at(4), 2, True)]), withdrawn=none)
    assert {(r.line, r.k, r.reason) for r in state.report().collect()} == {(1, 8, "missing"), (3, 1, "deleted")}
    state = state.advance(c([]), p([("t", 1, at(5), 3, False), ("t", 8, at(1), 4, False)]), withdrawn=none)
    assert state.report().count() == 0
    state = state.advance(c([]), p([("t", 1, at(6), 5, True)]), withdrawn=none)
    assert {(r.line, r.k, r.reason) for r in state.report().collect()} == {(3, 1, "deleted")}


def test_snapshots_in_order_equal_one_pass(spark):
    rnd = random.Random(5)
    parents = spark.createDataFrame([(f"k{rnd.randrange(12)}", rnd.randrange(1, 7)) for _ in range(40)], "ref_key string, ord int")
    refs = spark.createDataFrame([(i, rnd.choice([None, *[f"k{j}" for j in range(14)]]), rnd.randrange(1, 7)) for i in range(150)], "child int, ref_key string, ord int")
    state = OrphanTracker(["ref_key"], ["child"], pinned=True, settles=False)
    for ord in range(1, 7):
        mine = lambda df: df.filter(F.col("ord") == ord).withColumn("at", F.col("ord"))  # noqa: B023, E731
        state = state.advance(mine(refs), key_index(mine(parents), key=["ref_key"], at="at", row="at"), now=ord)
        known = parents.filter(F.col("ord") <= ord)
        want = {tuple(r) for r in snapshot_orphans(refs.filter(F.col("ord") <= ord), known).select("child", "ref_key", "reason").collect()}
        assert {(r.child, r.ref_key, r.reason) for r in state.report().collect()} == want


def test_join_is_not_tied_to_the_report(spark):
    """The report groups what was written, so nothing asks the join to keep a hot key in one task."""
    parents, children = feed(3)
    p = spark.createDataFrame(parents, "row long, t string, k long, at timestamp, op string")
    state = OrphanTracker(KEY, CHILD).advance(spark.createDataFrame(children, "t string, k long, line int, at timestamp"), key_index(p, key=KEY, at="at", row="row"))
    plan = state.report()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(t" in plan
