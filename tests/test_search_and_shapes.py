import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeplan.functions.periods import quarter_in
from lodeplan.operators import analytics, retrieval

DOCS = [(1, "red fox red"), (2, "the quick brown fox"), (3, None), (4, ""), (5, "RED panda_2 fox"), (6, "the the the"), (6, "the the the")]


def brute_bm25(docs, query, kept=lambda i: True):
    toks = {i: re.findall(r"[a-z0-9_]+", (t or "").lower()) for i, t in docs}
    average = sum(map(len, toks.values())) / len(toks)
    pool = {i: t for i, t in toks.items() if kept(i)}
    out = {}
    for i, t in pool.items():
        tf, s = Counter(t), 0.0
        for q in re.findall(r"[a-z0-9_]+", query.lower()):
            df = sum(q in x for x in pool.values())
            if tf[q]:
                s += math.log(1 + (len(pool) - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(t) / average))
        if s > 0:
            out[i] = round(s, 6)
    return sorted(out, key=lambda i: (-out[i], i)), out


@pytest.mark.parametrize("keep", [None, "doc_id <> 2"])
def test_bm25(spark, keep):
    docs = DOCS[:-1]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("token", F.lit("x"))
    queries = spark.createDataFrame([(1, "Red fox fox"), (2, "nothing"), (3, None), (4, "the")], "query_id long, text string")
    got = retrieval.bm25(df, queries, doc_id="doc_id", text="text", k=3, keep=keep).collect()
    for q, text in ((1, "Red fox fox"), (2, "nothing"), (4, "the")):
        order, scores = brute_bm25(docs, text, (lambda i: i != 2) if keep else (lambda i: True))
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.doc_id for r in own] == order[:3]
        assert all(abs(r.score - scores[r.doc_id]) < 2e-6 for r in own)
    assert retrieval.bm25(df.limit(0), queries, doc_id="doc_id", text="text", k=3).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_cosine(spark, block):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=4).round(2).tolist()) for i in range(40)] + [(50, [0.0] * 4), (51, None)]
    vectors += [(60, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    queries = df.filter("vec_id % 10 = 0 and v is not null").selectExpr("vec_id as query_id", "v as vector")
    got = retrieval.cosine(df, queries, doc_id="vec_id", vector="v", k=5, block=block).collect()
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    for q in {r.query_id for r in got}:
        scores = {i: round(float(unit(dict(vectors)[q]) @ unit(v)), 6) for i, v in vectors if v}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == {0, 10, 20, 30, 50, 60}
    odd = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)] + [(20, [float("nan"), 1.0]), (21, [float("inf"), 1.0])], "vec_id long, v array<double>")
    asked = odd.filter("vec_id in (1, 20)").selectExpr("vec_id as query_id", "v as vector")
    ranked = retrieval.cosine(odd, asked, doc_id="vec_id", vector="v", k=9, block=block).collect()
    assert {(r.query_id, r.doc_id) for r in ranked} == {(1, i) for i in range(9)}
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [0.0, 0.0]), (3, [1.0, 2.0]), (4, [1.0]), (5, None), (6, [float("inf"), 1.0])], "i int, v array<double>")
    assert [r.i for r in retrieval.usable_vectors(bad, vector="v", size=2).collect()] == [3]


def test_fusion_and_caps(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    got = retrieval.fuse(a, b).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10, 12] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    ranked = spark.createDataFrame([(1, i, i, "s" if i < 6 else None) for i in range(1, 9)], "query_id int, doc_id int, rank int, source string")
    kept = retrieval.cap_per_source(ranked, source="source", cap=2).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in kept] == [(1, 1), (2, 2), (6, 3), (7, 4)]


def test_visibility_and_terms(spark):
    objects = spark.createDataFrame([("a.b",), ("a.b.c",), ("a.bc",), ("d",), (None,)], "id string")
    denied = spark.createDataFrame([("a.b",)], "id string")
    assert {r.id for r in retrieval.visible(objects, denied, id="id").collect()} == {"a.bc", "d", None}
    terms = spark.createDataFrame([("Income", "x"), ("income ", "y"), (None, "z")], "term string, ref string")
    words = spark.createDataFrame([("INCOME",), ("other",), (None,), ("INCOME",)], "word string")
    assert {tuple(r) for r in retrieval.lookup_terms(terms, words).collect()} == {("INCOME", "x"), ("INCOME", "y")}


def test_funnel(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, *range(50)]), rnd.choice("abcx")) for _ in range(300)]
    df = spark.createDataFrame(rows, "u int, t int, k string")
    got = [r.users for r in analytics.funnel(df, user="u", at="t", kind="k", steps=["a", "b", "c"]).orderBy("step").collect()]
    counts = [0, 0, 0]
    for u in range(12):
        now = -1
        for i, s in enumerate("abc"):
            later = [t for x, t, k in rows if x == u and t is not None and k == s and t >= now]
            if not later:
                break
            now = min(later)
            counts[i] += 1
    assert got == counts
    assert [r.users for r in analytics.funnel(df.limit(0), user="u", at="t", kind="k", steps=["a", "b"]).collect()] == [0, 0]


def test_retention_of_an_empty_and_a_small_cohort(spark):
    rows = [(1, "2024-01-05"), (1, "2024-02-01"), (2, "2024-01-31"), (3, "2024-02-10"), (3, "2024-02-11"), (None, "2024-01-01"), (4, None)]
    df = spark.createDataFrame(rows, "u int, d string").withColumn("d", F.col("d").cast("timestamp"))
    got = {(r.cohort.month, r.period): (r.size, r.active, r.percent) for r in analytics.retention(df, user="u", at="d", periods=1).collect()}
    assert got == {(1, 0): (2, 2, 100.0), (1, 1): (2, 1, 50.0), (2, 0): (1, 1, 100.0), (2, 1): (1, 0, 0.0)}


def test_facts_meet_without_multiplying(spark):
    a = spark.createDataFrame([(1, 150), (4, 100), (None, 5)], "c int, revenue int")
    b = spark.createDataFrame([(1, 2), (5, 1), (None, 3)], "c int, tickets int")
    assert {tuple(r) for r in analytics.multi_fact([a, b], ["c"]).collect()} == {(1, 150, 2), (4, 100, None), (5, None, 1), (None, 5, 3)}
    parent = spark.createDataFrame([(1, 90.0), (2, 10.0)], "k int, amount double")
    child = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 0.0), (2, 0.0), (3, 1.0)], "k int, w double")
    assert sorted(r.allocated for r in analytics.allocate(parent, child, key=["k"], amount="amount", weight="w").collect()) == [5.0, 5.0, 30.0, 60.0]


def test_ranks_changes_and_spine(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([5, 5, 4, 3])], "g string, i int, v int")
    count = lambda ties: analytics.ranked(df, by=["g"], order=[F.desc("v"), *([F.asc("i")] if ties == "row_number" else [])], n=2, ties=ties).count()
    assert [count(t) for t in ("rank", "dense_rank", "row_number")] == [2, 3, 2]
    d = spark.sql("select 'k' k, date'2024-01-01' d, 0 n union all select 'k', date'2024-01-03', 4")
    full = analytics.spine(d, keys=["k"], bucket="d", step="1 day", fill={"n": 0})
    assert [r.n for r in full.orderBy("d").collect()] == [0, 0, 4]
    assert [r.percent for r in analytics.period_change(full, keys=["k"], bucket="d", value="n").orderBy("d").collect()] == [None, None, None]
    last = analytics.latest_then_sum(spark.createDataFrame([("e", "k", 1, 5), ("e", "k", 2, 7), ("f", "k", 1, 1)], "e string, k string, t int, v int"), entity=["e"], keys=["k"], at=["t"], value="v").first()
    assert (last.v, last.n) == (8, 2)


def test_quarters():
    assert [d.month for d in quarter_in("revenue in q4 2025 please")] == [10, 1] and quarter_in("q5 2025") is None


def test_nothing_is_open_to_a_principal_without_domains(spark):
    from lodeplan.plans.policy import Principal

    cards = spark.createDataFrame([("s", "a.b", "table", "a.b", "d", None), ("s", "a.b.c", "column", "a.b", "d", "x"), ("r", "a.b", "table", "a.b", "d", None), ("s", "e.f", "table", "e.f", None, "x")], "snapshot_id string, object_id string, object_type string, table_id string, domain string, access_scope string")
    seen = lambda p, **k: {r.object_id for r in retrieval.permitted(cards, p, "s", **k).collect()}
    assert seen(Principal("p", "t")) == set()
    assert seen(Principal("p", "t", frozenset("d"))) == {"a.b"}
    full = Principal("p", "t", frozenset("d"), frozenset("x"))
    assert seen(full) == {"a.b", "a.b.c"} and seen(full, types=["column"]) == {"a.b.c"} and seen(full, tables=[]) == set()
    assert seen(Principal("p", "t", frozenset("d"), frozenset("x"), denies={"discover": ("a.b.c.*",)})) == {"a.b"}
