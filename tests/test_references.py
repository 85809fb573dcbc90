import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodeplan.functions.keys import digest_text, folded
from lodeplan.operators.orphans import OrphanTracker, current_references, key_index, merge_index, snapshot_orphans
from lodeplan.operators.snapshots import diff_snapshots, snapshot_order

at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=s)
KEY, CHILD = ["t", "k"], ["t", "k", "line"]


def feed(seed, n=300):
    rnd = random.Random(seed)
    parents = [(i, "t", rnd.choice([None, *range(12)]), at(rnd.randrange(100)), rnd.choice(["insert", "update", "delete", None])) for i in range(n // 6)]
    children = [("t", rnd.choice([None, 0, 0, 0, *range(16)]), rnd.choice([None, *range(4)]), at(rnd.randrange(100))) for _ in range(n)]
    return parents, children + children[:20]


def expected(parents, children, until=None):
    current, first, earliest = {}, {}, {}
    for row, _, k, when, op in parents:
        if k is None or (until and when >= until):
            continue
        first[k] = min(first.get(k, when), when)
        current[k] = max(current.get(k, (when, row, op)), (when, row, op), key=lambda x: x[:2])
    for t, k, line, when in children:
        if k is not None and not (until and when >= until):
            earliest[k, line] = min(earliest.get((k, line), when), when)
    out = set()
    for (k, line), when in earliest.items():
        reason = "missing" if k not in first else "deleted" if current[k][2] == "delete" else "late" if first[k] > when else None
        if reason:
            out.add((k, line, reason, when))
    return out


def test_state_after_each_batch_equals_a_full_pass(spark):
    parents, children = feed(1)
    p = spark.createDataFrame(parents, "row long, t string, k long, at timestamp, op string")
    c = spark.createDataFrame(children, "t string, k long, line int, at timestamp")
    cuts = [at(0), at(30), at(31), at(70), at(200)]
    state = OrphanTracker(KEY, CHILD)
    for low, high in zip(cuts, cuts[1:]):
        mine = lambda df: df.filter((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high)))  # noqa: B023, E731
        state = state.advance(mine(c), key_index(mine(p), key=KEY, at="at", row="row", gone=F.col("op") == "delete"))
        got = {(r.k, r.line, r.reason, r.at.replace(tzinfo=timezone.utc)) for r in state.report().collect()}
        assert got == expected(parents, children, high)
        assert sum(r.n for r in state.snapshot_counts(F.lit("x")).collect()) == len(got)


def test_empty_sides(spark):
    parents, children = feed(2, 30)
    p = spark.createDataFrame(parents, "row long, t string, k long, at timestamp, op string")
    c = spark.createDataFrame(children, "t string, k long, line int, at timestamp")
    index = lambda df: key_index(df, key=KEY, at="at", row="row")
    assert OrphanTracker(KEY, CHILD).advance(c.limit(0), index(p)).report().count() == 0
    only = OrphanTracker(KEY, CHILD).advance(c, index(p.limit(0))).report()
    assert {r.reason for r in only.collect()} == {"missing"}
    assert only.count() == len({(k, line) for _, k, line, _ in children if k is not None})


def test_current_rows_state_the_references(spark):
    rows = [(1, "t", 1, 7, at(1), "insert"), (2, "t", 1, 8, at(2), "update"), (3, "t", 2, 7, at(1), "insert"), (4, "t", 2, None, at(3), "delete"), (5, "t", 3, None, at(1), "insert"), (6, "t", 1, 9, at(2), "insert")]
    df = spark.createDataFrame(rows, "row long, t string, k long, owner long, at timestamp, op string")
    one = key_index(df, key=KEY, at="at", row="row", gone=F.col("op") == "delete", carry=["owner"])
    halves = [key_index(df.filter(f"row % 2 = {i}"), key=KEY, at="at", row="row", gone=F.col("op") == "delete", carry=["owner"]) for i in (0, 1)]
    both = merge_index(halves[0], halves[1], KEY)
    for index in (one, both):
        got = {tuple(r) for r in current_references(index, child=KEY, carry="owner", key="owner").select("k", "owner").collect()}
        assert got == {(1, 9), (3, None)}


def test_snapshot_orphans(spark):
    parents = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 1), (None, 1), ("c", 1)], "ref_key string, ord int")
    refs = spark.createDataFrame([(i, k, o) for i, (k, o) in enumerate([("a", 1), ("a", 3), ("b", 1), ("c", 2), ("d", 1), (None, 1), ("d", 1)])] + [(4, "d", 1)], "child int, ref_key string, ord int")
    assert {tuple(r) for r in snapshot_orphans(refs, parents).select("child", "ref_key", "reason").collect()} == {(1, "a", "deleted"), (2, "b", "late"), (3, "c", "deleted"), (4, "d", "missing"), (6, "d", "missing")}
    assert snapshot_orphans(refs, parents).count() == 5
    assert snapshot_orphans(refs.limit(0), parents).count() == 0


def test_snapshot_changes(spark):
    snaps = spark.createDataFrame([("s1", at(1), "approved"), ("s2", at(2), "approved"), ("x", at(3), "draft"), ("s3", at(4), "approved")], "snapshot_id string, published_at timestamp, state string")
    order = snapshot_order(snaps)
    assert [(r.snapshot_id, r.ord, r.is_last) for r in order.orderBy("ord").collect()] == [("s1", 1, False), ("s2", 2, False), ("s3", 3, True)]
    rows = [
        ("s1", "same", 1, "sha256:AB", 1, 1), ("s2", "same", 1, "ab", 1, 1), ("s3", "same", 1, "SHA256:aB", 1, 1),
        ("s1", "gone", 1, "x", 1, 1), ("s2", "new", 1, None, 1, 1), ("s3", "new", 1, "", 1, 1),
        ("s1", "v", 1, "x", 1, 1), ("s2", "v", 2, "x", 1, 1), ("s3", "v", 2, "x", 1, 1), ("s3", "v", 2, "y", 0, 9), ("x", "draft", 1, "x", 1, 1),
        ("s1", None, 1, "x", 1, 1), ("s2", None, 1, "y", 1, 1), ("s3", None, 1, "y", 1, 2), ("s3", None, 1, "y", 1, 1), ("s1", "nv", None, "x", 1, 1), ("s2", "nv", None, "x", 1, 1), ("s3", "nv", 1, None, 1, 1),
    ]
    df = spark.createDataFrame(rows, "snapshot_id string, id string, version int, source_hash string, loaded int, record_id int").withColumn("hash", F.lit("clash")).withColumn("ord", F.lit(7)).withColumn("k0", F.lit("clash")).withColumn("_hash", F.lit("clash"))
    args = {"keys": ["id"], "compare": [F.col("version"), digest_text(F.col("source_hash"))], "latest": ["loaded", "record_id"]}
    got = [tuple(r) for r in diff_snapshots(df, order, **args).collect()]
    assert sorted(got, key=str) == sorted([("gone", "s2", "removed"), ("new", "s2", "added"), ("new", "s3", "changed"), ("v", "s2", "changed"), (None, "s2", "changed"), ("nv", "s3", "changed")], key=str)
    assert diff_snapshots(df.limit(0), order, **args).count() == 0


def test_folding(spark):
    df = spark.createDataFrame([(" \tNorth ",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(folded(F.col("s"))).collect()] == ["north", None, ""]
