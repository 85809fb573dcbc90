"""Time shards of intervals: by density, for every entity, and over many tasks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeplan.operators import intervals
from lodeplan.operators.intervals import RunBitmaps, interval_runs, set_runs

BITS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 8)), max_size=15)


def runs(rows):
    return RunBitmaps(*set_runs(*[np.array(x, np.int64) for x in ([r[0] for r in rows], [r[1] for r in rows], [r[1] + r[2] for r in rows])]))


def bits(b):
    return {(k, t) for k, lo, hi in zip(b.key, b.lo, b.hi) for t in range(lo, hi)}


@settings(max_examples=200, deadline=None)
@given(BITS, BITS)
def test_bitmap_algebra(a, b):
    a, b = runs(a), runs(b)
    assert bits(a | b) == bits(a) | bits(b) and bits(a & b) == bits(a) & bits(b)
    held = {k: {t for x, t in bits(a) if x == k} for k in range(3)}
    assert bits(a.clear_runs()) == {(k, t) for k, own in held.items() if own for t in range(min(own), max(own)) if t not in own}


def test_dense_entity_is_spread_over_tasks(spark):
    """An entity of 40,000 intervals of 3 us every 4 us within a second, and a quiet one."""
    dense = spark.range(40_000).select(F.lit("dense").alias("k"), F.timestamp_micros(F.col("id") * 4).alias("a"), F.timestamp_micros(F.col("id") * 4 + 3).alias("b"))
    quiet = spark.range(2).select(F.lit("quiet").alias("k"), F.timestamp_micros(F.col("id") * 10**15).alias("a"), F.timestamp_micros(F.col("id") * 10**15 + 5).alias("b"))
    every = dense.unionByName(quiet)
    ends = every.select(F.col("k").alias("k0"), F.unix_micros("a").alias("t")).unionByName(every.select("k", F.unix_micros("b") - 1).toDF("k0", "t"))
    divided = intervals._divisions(ends, ["k0"], intervals.SHARD_US, 2_000)
    placed = intervals._place(ends, "t", "s", ["k0"], intervals.SHARD_US, divided).groupBy("k0", "s_lo", "s_hi").count().collect()
    assert max(r["count"] for r in placed if r.k0 == "dense") <= 2_000 and sum(r.k0 == "dense" for r in placed) >= 40
    assert {r.s_hi - r.s_lo for r in placed if r.k0 == "quiet"} == {intervals.SHARD_US}
    got = interval_runs(every, entity=["k"], start="a", end="b", shard_rows=2_000, groups=16)
    assert {(r.kind, r.k): r["count"] for r in got.groupBy("kind", "k").count().collect()} == {("period", "dense"): 40_000, ("gap", "dense"): 39_999, ("period", "quiet"): 2, ("gap", "quiet"): 1}
    assert got.filter("kind = 'gap' and k = 'dense'").agg(F.min(F.col("to_us") - F.col("from_us")), F.max(F.col("to_us") - F.col("from_us"))).first()[:] == (1, 1)


@pytest.mark.parametrize("shard_rows", [50_000, 3])
def test_ends_at_one_microsecond(spark, shard_rows):
    """Many intervals that begin or end at the same instant can't be divided, and come out all the same."""
    df = spark.range(1, 200).select(F.lit(1).alias("k"), F.timestamp_micros(-F.col("id")).alias("a"), F.timestamp_micros(F.lit(0)).alias("b"))
    got = {tuple(r) for r in interval_runs(df.unionByName(df), entity=["k"], start="a", end="b", shard_rows=shard_rows).collect()}
    assert got == {("period", 1, -199, 0), ("overlap", 1, -198, 0)}
