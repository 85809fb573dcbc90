from dataclasses import replace
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodeplan.functions.expressions import Aggregate, Bool, Col, Compare, Lit, Ratio
from lodeplan.plans import demo
from lodeplan.plans.answers import Answer, answer, as_csv, as_markdown, prepare, verify
from lodeplan.plans.binding import Request, bind
from lodeplan.plans.catalog import Catalog, Column, Edge, Rule, load, problems, publish
from lodeplan.plans.errors import Reason, Refused
from lodeplan.plans.frames import build
from lodeplan.plans.gates import check
from lodeplan.plans.policy import Policy, Principal, Scope, decisions, matches

ts = lambda x: datetime.fromisoformat(x).replace(tzinfo=timezone.utc) if x else None
ORDER = "tenant_id string, order_id long, customer_id long, ordered_at timestamp, order_amount_usd decimal(18,2), order_status string, is_test boolean, refund_status string"
HIST = "tenant_id string, customer_id long, valid_from timestamp, valid_to timestamp, region_name string, is_internal boolean, is_test_customer boolean"
GOLD_HISTORY = [("T", 1, "2020-01-01", "2026-05-01", "North", 0, 0), ("T", 1, "2026-05-01", None, "South", 0, 0), ("T", 2, "2020-01-01", None, "North", 1, 0), ("T", 3, "2020-01-01", None, "North", 0, 1), ("T", 4, "2020-01-01", None, "North", 0, 0), ("T", 5, "2020-01-01", None, "North", 0, 0), ("O", 1, "2020-01-01", None, "North", 0, 0)]
GOLD_ORDERS = [
    ("T", 101, 1, "2026-04-15T10:00", 100, "completed", 0, "none"), ("T", 102, 1, "2026-06-15T10:00", 50, "completed", 0, "none"), ("T", 103, 4, "2026-04-20T10:00", 100, "completed", 0, "none"),
    ("T", 104, 2, "2026-04-10T10:00", 999, "completed", 0, "none"), ("T", 105, 3, "2026-04-10T11:00", 888, "completed", 0, "none"), ("T", 106, 5, "2026-04-11T10:00", 777, "completed", 1, "none"),
    ("T", 107, 5, "2026-04-12T10:00", 666, "completed", 0, "fully_refunded"), ("T", 108, 5, "2026-04-13T10:00", 555, "pending", 0, "none"), ("T", 109, 5, "2026-01-15T10:00", 444, "completed", 0, "none"),
    ("O", 101, 1, "2026-04-15T10:00", 5000, "completed", 0, "none"),
]
Q2 = {"start": "2026-04-01", "end": "2026-07-01"}
GOLD = Request(("finance.revenue@7",), ("customer.region_at_order@2",), grain="month", **Q2)


def resolver(spark, orders=GOLD_ORDERS, history=GOLD_HISTORY):
    o = spark.createDataFrame([(t, i, c, ts(a), Decimal(m), s, bool(x), r) for t, i, c, a, m, s, x, r in orders], ORDER)
    h = spark.createDataFrame([(t, c, ts(a), ts(b), r, bool(x), bool(y)) for t, c, a, b, r, x, y in history], HIST)
    return lambda table: {demo.ORDERS: o, demo.HISTORY: h}[table]


def ask(spark, request, principal="full_T", catalog=None, policy=None, **data):
    return answer(catalog or demo.catalog(), policy or demo.policy("T", "O"), principal, request, resolver(spark, **data))


def test_golden(spark):
    got = ask(spark, GOLD)
    assert got.status == "answered", got
    assert got.columns == ["month", "region_at_order", "revenue_usd"]
    assert [(r[0].month, r[1], r[2]) for r in got.rows] == [(4, "North", Decimal(200)), (6, "South", Decimal(50))]
    assert got.attested == {"commerce.orders_customers_asof@2": (5, 0, 0)}
    assert "global.exclude_internal_customers@2" in got.rules and len(got.gates) >= 18
    assert got.lineage == {"month": f"{demo.ORDERS}.ordered_at#month", "region_at_order": f"{demo.HISTORY}.region_name", "revenue_usd": "finance.revenue@7"}
    assert "| 2026-04-01 | North | 200.00 |" in as_markdown(got)
    assert as_csv(got).decode().splitlines()[0] == "month,region_at_order,revenue_usd"


@pytest.mark.parametrize(
    "request_, principal, rows",
    [
        (GOLD, "full_O", [("North", 5000)]),
        (Request(("finance.revenue",), **Q2), "full_T", [(250,)]),
        (Request(("commerce.order_count",), **Q2), "full_T", [(4,)]),
        (Request(("finance.revenue",), start="2026-01-01", end="2026-04-01"), "full_T", [(444,)]),
        (Request(("finance.revenue",), ("customer.region_at_order",), **Q2), "full_T", [("North", 200), ("South", 50)]),
        (Request(("commerce.average_order",), **Q2), "full_T", [(229.0,)]),
        (Request(("finance.revenue", "commerce.order_count"), ("customer.region_at_order",), **Q2), "full_T", [("North", 200, 3), ("South", 50, 1)]),
        (Request(("finance.revenue",), ("customer.region_at_order",), order_by=(("revenue_usd", "asc"),), limit=1, **Q2), "full_T", [("South", 50)]),
        (Request(("finance.revenue",), filters=(("customer.region_at_order", "eq", ("South",)),), **Q2), "full_T", [(50,)]),
        (Request(("finance.revenue",), filters=((f"{demo.ORDERS}.order_id", "not_in", (101, 102)),), **Q2), "full_T", [(100,)]),
    ],
)
def test_totals(spark, request_, principal, rows):
    got = ask(spark, request_, principal)
    assert got.status == "answered", got
    assert [tuple(float(v) if isinstance(v, Decimal) else v for v in r[1 if request_.grain else 0 :]) for r in got.rows] == rows


def test_counterexamples(spark):
    more = [*GOLD_ORDERS, ("T", 201, 4, "2026-04-25T10:00", 200, "completed", 0, "partially_refunded")]
    assert ask(spark, Request(("finance.revenue",), **Q2), orders=more).rows == [(Decimal(450),)]
    one = [("T", 1, "2020-01-01", "2026-06-01", "North", 0, 0), ("T", 1, "2026-05-01", None, "South", 0, 0), ("T", 4, "2020-01-01", None, "North", 0, 0)]
    two = [("T", 101, 1, "2026-05-15", 100, "completed", 0, "none"), ("T", 103, 4, "2026-04-20", 100, "completed", 0, "none")]
    got = ask(spark, GOLD, orders=two, history=one)
    assert (got.status, got.reason) == ("blocked", "FAN_OUT_UNPROVEN") and "1 of 2" in got.notes[0]
    gap = [("T", 1, "2020-01-01", "2026-04-01", "North", 0, 0), ("T", 1, "2026-05-01", None, "South", 0, 0)]
    got = ask(spark, GOLD, orders=two[:1] and [("T", 101, 1, "2026-04-15", 100, "completed", 0, "none")], history=gap)
    assert (got.status, got.reason) == ("blocked", "RESULT_CONTRACT_BREACH") and "under-report" in got.notes[0]
    same = [("T", 1, 4, "2026-04-15", 100, "completed", 0, "none"), ("T", 2, 4, "2026-04-16", 100, "completed", 0, "none")]
    assert ask(spark, Request(("finance.revenue",), ("customer.region_at_order",), **Q2), orders=same).rows == [("North", Decimal(200))]
    got = ask(spark, GOLD, orders=[])
    assert (got.status, got.rows, got.notes) == ("answered", [], ["no matching data"]) and as_csv(got) == b""


@pytest.mark.parametrize(
    "request_, principal, reason",
    [
        (GOLD, "restricted", Reason.NOT_AUTHORIZED),
        (replace(GOLD, grain="week"), "full_T", Reason.UNSUPPORTED_CAPABILITY),
        (Request(()), "full_T", Reason.UNSUPPORTED_CAPABILITY),
        (Request(("finance.revenue@6",)), "full_T", Reason.STALE_SNAPSHOT),
        (Request(("finance.nothing",)), "full_T", Reason.OBJECT_NOT_FOUND),
        (Request(("finance.revenue",), grain="month"), "full_T", Reason.VALIDATION_FAILED),
        (Request(("finance.revenue",), start="2026-07-01", end="2026-04-01"), "full_T", Reason.VALIDATION_FAILED),
        (replace(GOLD, order_by=(("nothing", "asc"),)), "full_T", Reason.VALIDATION_FAILED),
        (replace(GOLD, limit=0), "full_T", Reason.VALIDATION_FAILED),
        (Request(("finance.revenue",), filters=((f"{demo.ORDERS}.order_id", "eq", (1, 2)),)), "full_T", Reason.UNSUPPORTED_OPERATOR),
        (Request(("finance.revenue",), filters=((f"{demo.ITEMS}.product_id", "eq", (1,)),)), "full_T", Reason.MANDATORY_RULE_UNRESOLVED),
        (GOLD, "nobody", Reason.NOT_AUTHORIZED),
    ],
)
def test_refusals(spark, request_, principal, reason):
    got = ask(spark, request_, principal)
    assert (got.status, got.reason) == ("unavailable", str(reason))


def test_fan_out_and_ambiguity():
    full = demo.policy("T").scope("full_T", "demo-1")
    no_guard = Catalog("demo-1", [r for r in demo.catalog().records if not r.id.endswith("item_revenue_guard")])
    with pytest.raises(Refused) as refused:
        bind(no_guard, full, Request(("finance.revenue",), filters=((f"{demo.ITEMS}.product_id", "eq", (1,)),)), "finance.revenue")
    assert refused.value.reason == Reason.FAN_OUT_UNPROVEN
    asof = demo.catalog().get("edge", "commerce.orders_customers_asof")
    doubled = Catalog("demo-1", [*demo.catalog().records, replace(asof, id="commerce.orders_customers_other")])
    count = Request(("commerce.order_count",), filters=((f"{demo.HISTORY}.region_name", "eq", ("North",)),))
    no_rule = Catalog("demo-1", [r for r in doubled.records if not r.id.endswith("exclude_internal_customers")])
    with pytest.raises(Refused) as refused:
        bind(no_rule, full, count, "commerce.order_count")
    assert refused.value.reason == Reason.AMBIGUOUS_PATH


@pytest.fixture(scope="module")
def bound():
    return bind(demo.catalog(), demo.policy("T").scope("full_T", "demo-1"), GOLD, "finance.revenue")


def _tampered(spark, bound, change):
    """The golden frame, built by hand with one change."""
    o, h = resolver(spark)(demo.ORDERS).alias("t0"), resolver(spark)(demo.HISTORY).alias("t1")
    c = F.col
    start, end = F.lit(ts("2026-04-01")), F.lit(ts("2026-07-01"))
    left = [c("t0.tenant_id") == "T", c("t0.ordered_at") >= start, c("t0.ordered_at") < end, c("t0.order_status") == "completed", c("t0.is_test") == False, c("t0.refund_status") != "fully_refunded"]  # noqa: E712
    right = [c("t1.tenant_id") == "T", c("t1.is_internal") == False, c("t1.is_test_customer") == False]  # noqa: E712
    on = [c("t0.tenant_id") == c("t1.tenant_id"), c("t0.customer_id") == c("t1.customer_id"), c("t0.ordered_at") >= c("t1.valid_from"), (c("t0.ordered_at") < c("t1.valid_to")) | c("t1.valid_to").isNull()]
    parts = {"left": left, "right": right, "on": on, "measure": F.sum("t0.order_amount_usd"), "how": "inner", "table": h}
    change(parts)
    for p in parts["left"]:
        o = o.filter(p)
    h = parts["table"]
    for p in parts["right"]:
        h = h.filter(p)
    condition = parts["on"][0]
    for p in parts["on"][1:]:
        condition = condition & p
    return o.join(h, condition, parts["how"]).groupBy(F.date_trunc("month", "t0.ordered_at").alias("month"), c("t1.region_name").alias("region_at_order")).agg(parts["measure"].alias("revenue_usd"))


def test_hand_built_frame_passes(spark, bound):
    assert "obligations" in check(bound, _tampered(spark, bound, lambda p: None), demo.policy("T"))
    assert "obligations" in check(bound, build(bound, resolver(spark)), demo.policy("T"))


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda p: p["left"].pop(0), Reason.MANDATORY_RULE_UNRESOLVED),
        (lambda p: p["left"].pop(3), Reason.MANDATORY_RULE_UNRESOLVED),
        (lambda p: p["right"].__setitem__(1, F.col("t1.is_internal") == True), Reason.MANDATORY_RULE_UNRESOLVED),  # noqa: E712
        (lambda p: p["left"].__setitem__(0, F.col("t0.tenant_id") == "O"), Reason.MANDATORY_RULE_UNRESOLVED),
        (lambda p: p["left"].append(F.col("t0.order_id") > 5), Reason.MANDATORY_RULE_UNRESOLVED),
        (lambda p: p["on"].pop(3), Reason.NO_APPROVED_PATH),
        (lambda p: p["on"].__setitem__(2, F.col("t0.ordered_at") > F.col("t1.valid_from")), Reason.NO_APPROVED_PATH),
        (lambda p: p.__setitem__("how", "left"), Reason.NO_APPROVED_PATH),
        (lambda p: p.__setitem__("measure", F.sum_distinct("t0.order_amount_usd")), Reason.VALIDATION_FAILED),
        (lambda p: p.__setitem__("measure", F.sum(F.abs("t0.order_amount_usd"))), Reason.UNSAFE_QUERY),
        (lambda p: p.__setitem__("table", p["table"].alias("x")), Reason.UNSAFE_QUERY),
    ],
)
def test_tampered_plans_are_refused(spark, bound, change, reason):
    try:
        df = _tampered(spark, bound, change)
    except Exception:
        return  # Spark itself refuses to analyze it
    with pytest.raises(Refused) as refused:
        check(bound, df, demo.policy("T"))
    assert refused.value.reason in (reason, Reason.UNRESOLVED_REFERENCE)


def test_epoch_change_blocks(spark, bound):
    with pytest.raises(Refused) as refused:
        check(bound, build(bound, resolver(spark)), Policy(2, {}))
    assert refused.value.reason == Reason.POLICY_EPOCH_CHANGED


def test_time_zone_slot(spark):
    dst = [("T", 1, 4, "2026-03-08T06:30", 100, "completed", 0, "none"), ("T", 2, 4, "2026-03-08T07:30", 50, "completed", 0, "none"), ("T", 3, 4, "2026-03-01T05:00", 25, "completed", 0, "none")]
    request = Request(("finance.revenue",), start="2026-02-01", end="2026-04-01", grain="month")
    assert [r[1] for r in ask(spark, request, orders=dst).rows] == [175]
    west = ask(spark, replace(request, timezone="America/Los_Angeles"), orders=dst)
    assert [(r[0].month, r[1]) for r in west.rows] == [(2, 25), (3, 150)] and west.timezone == "America/Los_Angeles"


def test_policy():
    assert matches("a.b.*", "a.b") and matches("a.b.*", "a.b.c") and not matches("a.b.*", "a.bc") and matches("a.b", "a.b")
    p = Principal("p", "t", grants={"read": ("a.*", "a.secret.x"), "disclose": ("a.*",), "discover": ("a.*",)}, denies={"discover": ("a.secret.*",), "read": ("a.y",)})
    assert p.may("read", "a.b") and p.may("use_in_predicate", "a.b") and not p.may("execute_metric", "a.b")
    assert not p.may("read", "a.secret.z") and p.may("read", "a.secret.x") and not p.may("disclose", "a.secret.x")
    assert not p.may("read", "a.y") and not p.may("use_in_predicate", "a.y") and not Principal("q", "t").may("read", "a.b")
    with pytest.raises(Refused):
        Scope(p, 1, "s", object())


def test_decisions_equal_the_principal(spark):
    policy = demo.policy("T", "O")
    ids = [r.id for r in demo.catalog().records] + ["finance", "finance.x.y", "warehouse"]
    got = {(r.principal, r.action, r.id): r.allowed for r in decisions(spark.createDataFrame([(i,) for i in [*ids, None, ids[0]]], "id string"), policy, id="id").collect()}
    assert got == {(p.id, a, i): p.may(a, i) for p in policy.principals.values() for a in ("discover", "read", "use_in_predicate", "execute_metric", "disclose") for i in ids}


def test_publication(tmp_path):
    catalog = demo.catalog()
    assert not list(problems(catalog))
    path = publish(catalog, str(tmp_path))
    assert load(path).records == catalog.records
    with pytest.raises(Refused):
        publish(catalog, str(tmp_path))
    path.write_text(path.read_text().replace('"Revenue"', '"Income"'))
    with pytest.raises(Refused):
        load(path)
    broken = Catalog("x", [*catalog.records, Column(id="a.b.c", table="a.b", name="c", data_type="INT")])
    assert list(problems(broken)) == ["a.b.c: no table a.b"]
    assert catalog.lookup(" Turnover") == ["finance.revenue@7"] == catalog.lookup("SALES")
    with pytest.raises(Refused):
        Column(id="a.b.c", table="a.x", name="c", data_type="INT")
    with pytest.raises(Refused):
        Rule(id="a.b", rule_class="security_obligation", activation=("always", None), effect=("require_tenant_scope", None), overrideable=True)


def test_rule_conflict_and_ratio_modes(spark):
    two = [Rule(id=f"x.zone_{z}", rule_class="contextual", activation=("always", None), effect=("set_slot", ("timezone", z))) for z in ("a", "b")]
    with pytest.raises(Refused) as refused:
        bind(Catalog("demo-1", [*demo.catalog().records, *two]), demo.policy("T").scope("full_T", "demo-1"), GOLD, "finance.revenue")
    assert refused.value.reason == Reason.RULE_CONFLICT
    from lodeplan.functions.expressions import Context, columns_in, from_json, to_json

    df = spark.createDataFrame([(1, 0), (2, 0)], "a int, b int")
    ctx = Context(lambda id: F.col(id))
    value = lambda zero: df.agg(ctx.measure(Ratio(Aggregate("sum", Col("a")), Aggregate("sum", Col("b")), zero)).alias("r")).first()[0]
    assert value("null") is None and value("zero") == 0.0
    with pytest.raises(Exception, match="division by zero"):
        value("error")
    tree = Bool("or", (Compare("lt", Col("x.a"), Lit(3, "integer")), Bool("not", (Compare("eq", Col("x.b"), Lit("q")),))))
    assert from_json(to_json(tree)) == tree and columns_in(tree) == {"x.a", "x.b"}


def test_result_contract():
    assert verify(["k", "m"], [(1, None)], ["k"], ["m"]) == ["m has empty values"]
    for columns, rows in ((["m", "k"], []), (["k", "m"], [(1, 2), (1, 3)]), (["k", "m"], [(1, float("nan"))])):
        with pytest.raises(Refused):
            verify(columns, rows, ["k"], ["m"])
    assert "denied" not in as_markdown(Answer("blocked", reason="X"))


def test_left_edges_keep_their_rows(spark):
    catalog = demo.catalog()
    edge = catalog.get("edge", "commerce.orders_customers_asof")
    left = Catalog("demo-1", [replace(edge, join_type="left", attested=False) if r is edge else r for r in catalog.records if not r.id.endswith("exclude_internal_customers")])
    request = Request(("commerce.order_count",), ("customer.region_at_order",))
    _, df, _ = prepare(left, demo.policy("T"), "full_T", request, resolver(spark, history=GOLD_HISTORY[:2]))
    assert {tuple(r) for r in df.collect()} == {("North", 1), ("South", 1), (None, 5)}
    assert isinstance(edge, Edge)


def test_questions(spark):
    from lodeplan.plans.questions import Question, propose, repaired, resume

    catalog, scope = demo.catalog(), demo.policy("T", "O").scope("full_T", "demo-1")
    got = propose(catalog, scope, "Show turnover by territory, monthly, in Q2 2026")
    assert got == Request(("finance.revenue@7",), ("customer.region_at_order@2",), ts("2026-04-01"), ts("2026-07-01"), grain="month")
    assert ask(spark, got).rows[0][1:] == ("North", Decimal(200))
    assert resume(catalog, scope, propose(catalog, scope, "weekly revenue Q2 2026"), "2").grain == "month"
    both = propose(catalog, scope, "sales and orders in q1 2026")
    assert isinstance(both, Question) and len(both.options) == 2
    assert resume(catalog, scope, both, "finance.revenue@7").metrics == ("finance.revenue@7",)
    with pytest.raises(Refused):
        resume(catalog, scope, both, "something else")
    later = propose(catalog, scope, "monthly revenue")
    assert later.slot == "period" and resume(catalog, scope, later, "Q1 2026").start == ts("2026-01-01")
    for text, reason in (("weather", Reason.OBJECT_NOT_FOUND), ("revenue", Reason.NOT_AUTHORIZED)):
        with pytest.raises(Refused) as refused:
            propose(catalog, demo.policy("T").scope("restricted", "demo-1"), text)
        assert refused.value.reason == reason
    assert repaired(replace(GOLD, order_by=(("x", "asc"), ("month", "desc"))), ["month"]).order_by == (("month", "desc"),)


def test_fingerprints_and_the_tenant_boundary(spark, bound):
    from lodeplan.plans.frames import preflight, within_tenant

    other = bind(demo.catalog(), demo.policy("T", "O").scope("full_O", "demo-1"), GOLD, "finance.revenue")
    again = bind(demo.catalog(), demo.policy("T").scope("full_T", "demo-1"), GOLD, "finance.revenue")
    assert bound.fingerprint == again.fingerprint != other.fingerprint
    own = within_tenant(resolver(spark), demo.catalog(), "O")
    assert own(demo.ORDERS).count() == 1 and own(demo.HISTORY).count() == 1
    assert "HashAggregate" in preflight(build(bound, resolver(spark)))


def test_card_index(spark, tmp_path):
    from lodeplan.sources.cards import CardIndex

    cards = spark.createDataFrame([("s", "a.b", [1.0, 2.0]), ("s", "a.c", None), ("r", "a.b", [1.0]), ("m", "x", [1.0]), ("m", "y", [1.0, 2.0])], "snapshot_id string, object_id string, embedding array<double>")
    index = CardIndex(spark, str(tmp_path))
    assert not index.is_ready("s", 2)
    index.index(cards, "s")
    assert index.is_ready("s", 2) and not index.is_ready("s", 3)
    for snapshot in ("s", "m"):
        with pytest.raises(Refused):
            index.index(cards, snapshot)
    index.retire("s")
    assert not index.is_ready("s", 2)
