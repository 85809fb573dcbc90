"""The ledger's size and ranges: late updates stay local, and one entity is worked on by many tasks."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeplan.operators.history import UNSENT, Timelines, build_ledger, history
from lodeplan.operators.slots import Slots


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 299), st.booleans()), max_size=80), st.integers(0, 299))
def test_neighbours(steps, probe):
    slots, plain = Slots(300), set()
    for i, add in steps:
        (slots.add if add else slots.remove)(i)
        (plain.add if add else plain.discard)(i)
    assert slots.before(probe) == max((x for x in plain if x < probe), default=-1)
    assert slots.after(probe) == min((x for x in plain if x > probe), default=-1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.sampled_from([UNSENT, 0, 1, 2])), max_size=30))
def test_timeline_after_each_update(updates):
    """Two entities of four points: open rows are the longest stretches of what is sent so far."""
    lines, sent = Timelines([0] * 4 + [1] * 4), {}
    for i, (point, code) in enumerate(updates):
        lines.apply(i, point, code)
        sent[point] = code
        want, held = set(), None
        for p in range(8):
            held = None if p == 4 else held
            c = sent.get(p, UNSENT)
            if c != UNSENT and (held is None or c != held[1]):
                held = (p, c)
                want.add(held)
        open_rows = [j for j in range(len(lines.begin)) if lines.closed[j] < 0]
        assert {(lines.begin[j], lines.code[j]) for j in open_rows} == want and len(open_rows) == len(want)
        for j in open_rows:
            later = [p for p, _ in want if p > lines.begin[j] and (p < 4) == (lines.begin[j] < 4)]
            assert lines.end[j] == min(later, default=-1)


def _late(spark, n):
    """Half the updates send x on time, the other half y, all of them late and before the first x."""
    late = F.col("id") >= n // 2
    at = F.when(late, F.col("id") - n // 2).otherwise(F.col("id") + n // 2)
    return spark.range(n).select(F.lit(1).alias("k"), F.timestamp_micros(at).alias("at"), F.timestamp_micros("id").alias("rec"), "id", F.lit(False).alias("gone"), F.when(~late, F.col("id").cast("string")).alias("x"), F.when(late, F.col("id").cast("string")).alias("y"))


def test_late_updates_stay_local(spark, tmp_path):
    path = str(tmp_path / "ledger")
    args = {"entity": ["k"], "at": "at", "received": "rec", "row": "id", "is_delete": F.col("gone"), "attributes": ["x", "y"]}
    assert build_ledger(_late(spark, 4000), **args).count() <= 12_000
    # One entity of a million updates: many ranges, each of bounded size, and still linear.
    ledger = build_ledger(_late(spark, 1_000_000), **args)
    ledger.write.mode("overwrite").parquet(path)
    ledger = spark.read.parquet(path)
    sizes = [r["count"] for r in ledger.groupBy("slice").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 100_000 and sum(sizes) <= 3_000_000
    versions = history(ledger, entity=["k"], attributes=["x", "y"])
    assert versions.agg(F.count(F.lit(1)), F.min("from_us"), F.count("to_us"), F.sum(F.col("to_us") - F.col("from_us"))).first()[:] == (1_000_000, 0, 999_999, 999_999)


def test_splitting_changes_nothing(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(60)]), rnd.choice([None, *range(60)]), i, rnd.random() < 0.1, rnd.choice([None, "a", "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, at long, rec long, id long, gone boolean, x string").withColumn("at", F.timestamp_micros("at")).withColumn("rec", F.timestamp_micros("rec"))
    args = {"entity": ["k"], "at": "at", "received": "rec", "row": "id", "is_delete": F.col("gone"), "attributes": ["x"]}
    found = [sorted(map(tuple, history(build_ledger(df, groups=g, **args), entity=["k"], attributes=["x"]).collect()), key=str) for g in (1, 4, 9)]
    assert found[0] == found[1] == found[2] and found[0]
