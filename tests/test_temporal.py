import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeplan.operators.asof import known_as_of, search
from lodeplan.operators.history import build_ledger, history
from lodeplan.operators.intervals import covered_twice, interval_runs, set_runs

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
at = lambda s: None if s is None else BASE + timedelta(seconds=s)
us = lambda s: int((BASE + timedelta(seconds=s)).timestamp()) * 1_000_000

VERSION = st.tuples(st.integers(0, 2), st.integers(0, 12), st.integers(1, 9), st.integers(0, 12))
EVENT = st.tuples(st.integers(0, 3), st.integers(-1, 25), st.integers(-1, 25))


@settings(max_examples=300, deadline=None)
@given(st.lists(VERSION, max_size=25), st.lists(EVENT, max_size=25))
def test_persistent_trees_find_the_version_known_then(versions, events):
    rows = sorted((e, rec, a, i, a + length) for i, (e, a, length, rec) in enumerate(versions))
    cols = [np.array([r[k] for r in rows], np.int64) for k in range(5)]
    ev = [np.array([e[k] for e in events], np.int64) for k in range(3)]
    got = search(ev[0], ev[1], ev[2], cols[0], cols[2], cols[4], cols[1])
    for (entity, known, valid), g in zip(events, got):
        fits = [i for i, r in enumerate(rows) if r[0] == entity and r[1] <= known and r[2] <= valid < r[4]]
        assert g == (fits[-1] if fits else -1)


def test_known_as_of(spark):
    rnd = random.Random(3)
    versions, events = [], []
    for i in range(400):
        start = rnd.choice([None, *range(0, 60)]) if rnd.random() < 0.1 else rnd.randrange(60)
        end = None if rnd.random() < 0.3 else (start or 0) + rnd.randrange(-3, 30)
        versions.append((i, "t", rnd.choice([1, 1, 1, 2, 3, None]), at(start), at(end), at(rnd.randrange(60)), f"r{i}"))
    versions += versions[:20]  # repeated rows
    for i in range(600):
        events.append((i, "t", rnd.choice([1, 1, 1, 2, 4, None]), at(rnd.choice([None, *range(80)])), at(rnd.randrange(80)), "x"))
    v = spark.createDataFrame(versions, "version_id long, t string, c long, valid_from timestamp, valid_to timestamp, recorded_at timestamp, note string")
    e = spark.createDataFrame(events, "event_id long, t string, c long, valid timestamp, known timestamp, version_id string")
    args = {"entity": ["t", "c"], "event_id": ["event_id", "t"], "valid_at": "valid", "known_at": "known", "valid_from": "valid_from", "valid_to": "valid_to", "recorded_at": "recorded_at", "version_id": "version_id", "carry": ["note", "t"]}
    want = {}
    for i, t, c, valid, known, _ in events:
        fits = [x for x in versions if c is not None and valid is not None and x[2] == c and x[3] is not None and x[5] <= known and x[3] <= valid and (x[4] is None or x[4] > x[3] and valid < x[4])]
        if fits:
            want[i] = max(fits, key=lambda x: (x[5], x[3], x[0]))[6]
    for rows in (50_000, 7):  # one group, and hot entities split over many
        got = known_as_of(e, v, shard_rows=rows, **args)
        assert got.columns == ["event_id", "t", "note", "version_t"]
        assert {r.event_id: r.note for r in got.collect()} == want and got.count() == len(want)
    # Known and valid at once: entities with many versions are cut into time slices as well.
    args["known_at"] = "valid"
    want = {}
    for i, t, c, valid, _, _ in events:
        fits = [x for x in versions if c is not None and valid is not None and x[2] == c and x[3] is not None and x[5] <= valid and x[3] <= valid and (x[4] is None or x[4] > x[3] and valid < x[4])]
        if fits:
            want[i] = max(fits, key=lambda x: (x[5], x[3], x[0]))[6]
    for rows in (50_000, 60, 7):
        got = known_as_of(e, v, shard_rows=rows, **args)
        assert {r.event_id: r.note for r in got.collect()} == want and got.count() == len(want)
    assert known_as_of(e.limit(0), v, **args).count() == 0
    assert known_as_of(e, v.limit(0), **args).count() == 0


def brute_runs(rows):
    """Coverage second by second; open ends reach the horizon 1000."""
    out = set()
    for key, own in rows.items():
        own = {(a, 1000 if b is None else b) for a, b in own}
        cover = [sum(a <= s < b for a, b in own) for s in range(-200, 1001)]
        for kind, test in (("period", lambda n: n >= 1), ("overlap", lambda n: n >= 2), ("gap", lambda n: n == 0)):
            start = None
            for i, n in enumerate([*cover[:-1], None]):
                good = n is not None and test(n)
                if good and start is None:
                    start = i
                if not good and start is not None:
                    a, b = start - 200, i - 200
                    if kind != "gap" or (any(cover[:start]) and any(cover[i:-1])):
                        out.add((kind, key, us(a), -1 if b == 1000 else us(b)))
                    start = None
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 8)), max_size=30))
def test_run_bitmaps(rows):
    key = np.array([r[0] for r in rows], np.int64)
    lo = np.array([r[1] for r in rows], np.int64)
    hi = lo + np.array([r[2] for r in rows], np.int64)
    for f, least in ((set_runs, 1), (covered_twice, 2)):
        k, a, b = f(key, lo, hi)
        bits = {(x, t) for x, s, e in zip(k, a, b) for t in range(s, e)}
        want = {(x, t) for x in range(3) for t in range(30) if sum((key == x) & (lo <= t) & (t < hi)) >= least}
        assert bits == want
        assert all(k[i] != k[i + 1] or b[i] < a[i + 1] for i in range(len(k) - 1))


@pytest.mark.parametrize("width, shard_rows", [(10, 0), (7, 0), (1000, 0), (1, 0), (9, 45), (10, 1000)])
def test_interval_runs(spark, width, shard_rows):
    rnd = random.Random(width)
    rows, by = [], defaultdict(set)
    for _ in range(250):
        key = rnd.choice(["a", "b", "c", "d", "e", None])
        start = rnd.choice([None, *range(-100, 100)]) if rnd.random() < 0.05 else rnd.randrange(-100, 100)
        end = None if rnd.random() < 0.04 and key in ("d", "e") else (start or 0) + rnd.choice([-1, 0, 1, 2, 3, 5, 10, 20, 40])
        rows.append((key, at(start), at(end), "x"))
        if start is not None and (end is None or end > start):
            by[key].add((start, end))
    rows += rows[:30]
    df = spark.createDataFrame(rows, "k string, a timestamp, b timestamp, kind string")
    got = {tuple(r) for r in interval_runs(df, entity=["k"], start="a", end="b", shard_rows=shard_rows, shard_us=width * 1_000_000, groups=3).collect()}
    assert got == brute_runs(by)
    assert interval_runs(df.limit(0), entity=["k"], start="a", end="b").count() == 0


def brute_history(updates, until=None):
    """Versions of one entity from (at, received, id, gone, values)."""
    last = {}
    for u in sorted((u for u in updates if until is None or u[1] <= until), key=lambda u: (u[1], u[2])):
        last[u[0]] = u
    out, state, alive = [], (None, None), False
    for t in sorted(last):
        _, _, _, gone, values = last[t]
        if gone:
            if alive:
                out[-1][1] = t
            state, alive = (None, None), False
            continue
        new = tuple(h if v is None else v for h, v in zip(state, values))
        if not alive or new != state:
            if alive:
                out[-1][1] = t
            out.append([t, None, new])
        state, alive = new, True
    return {(us(a), None if b is None else us(b), *s) for a, b, s in out}


@pytest.mark.parametrize("shard_rows", [1000, 5])
def test_history(spark, shard_rows):
    rnd = random.Random(shard_rows)
    updates, by = [], defaultdict(list)
    for i in range(300):
        key = rnd.choice([1, 1, 1, 2, 3])
        u = (rnd.randrange(40), rnd.randrange(100), i, rnd.random() < 0.12, (rnd.choice([None, "n", "s", "w"]), rnd.choice([None, True, False])))
        updates.append((key, at(u[0]), at(u[1]), i, u[3], u[4][0], u[4][1], "x"))
        by[key].append(u)
    updates += updates[:25]
    updates += [(None, at(1), at(1), 900, False, "n", True, "x"), (1, None, at(1), 901, False, "n", True, "x"), (1, at(1), None, 902, False, "n", True, "x")]
    df = spark.createDataFrame(updates, "k long, changed timestamp, received timestamp, id long, gone boolean, region string, flag boolean, shard string")
    ledger = build_ledger(df, entity=["k"], at="changed", received="received", row="id", is_delete=F.col("gone"), attributes=["region", "flag"], shard_rows=shard_rows, groups=3)
    for until in (None, 30, 70):
        got = history(ledger, entity=["k"], attributes=["region", "flag"], as_of_us=None if until is None else us(until)).collect()
        want = {(k, *v) for k, own in by.items() for v in brute_history(own, until)}
        assert {(r.k, r.from_us, r.to_us, r.region, r.flag) for r in got} == want and len(got) == len(want)
    # Nothing is overwritten: a closed row never overlaps its successor in recorded time.
    rows = ledger.toPandas()
    assert (rows.recorded_to_us.isna() | (rows.recorded_to_us >= rows.recorded_from_us)).all()
    empty = build_ledger(df.limit(0), entity=["k"], at="changed", received="received", row="id", is_delete=F.col("gone"), attributes=["region"])
    assert history(empty, entity=["k"], attributes=["region"]).count() == 0
