"""Queries of the governed metric layer and the operators beneath it, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplan.functions.expressions import Aggregate, Bool, Col, Compare, Context, In, IsNull, Lit, Member, Param, Ratio
from lodeplan.functions.periods import bucket, fiscal_bucket, valid_at
from lodeplan.functions.text import excerpt, short_id, tokens
from lodeplan.operators import analytics, catalogs, retrieval
from lodeplan.plans import demo
from lodeplan.plans.answers import duplicates, prepare
from lodeplan.plans.binding import Request, bind
from lodeplan.plans.frames import attestations
from lodeplan.plans.policy import Policy, Principal, decisions
from lodeplan.queries.problem_sql import NODES
from lodeplan.queries.problems import _flat
from lodeplan.sources.cards import CardIndex
from lodeplan.sources.tables import read_csv, scratch, table, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# The governed requests: the star schema as orders and customer history, half a year of one tenant.

PERIOD = {"start": "1997-10-01", "end": "1998-04-01"}
_T = "CASE {0} % 3 WHEN 0 THEN 'tenant-a' WHEN 1 THEN 'tenant-b' ELSE 'tenant-c' END"
_HISTORY = """h AS (
  SELECT {t} AS tenant_id, c_custkey AS customer_id, TIMESTAMP '1990-01-01' AS valid_from, TIMESTAMP '1998-01-01' AS valid_to, r_name AS region_name, c_custkey % 10 = 0 AS is_internal, c_custkey % 17 = 0 AS is_test_customer
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT {t}, c_custkey, TIMESTAMP '{moved}', NULL, r_name, c_custkey % 10 = 0, c_custkey % 17 = 0
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON (n_regionkey + 1) % 5 = r_regionkey)"""
_STAR = (
    """WITH o AS (
  SELECT {t} AS tenant_id, o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ordered_at, CAST(o_totalprice AS DECIMAL(18,2)) AS order_amount_usd,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS order_status, o_orderkey % 13 = 0 AS is_test,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'fully_refunded' WHEN '2-HIGH' THEN 'partially_refunded' ELSE 'none' END AS refund_status
  FROM orders), """.replace("{t}", _T.format("o_custkey"))
    + _HISTORY.replace("{t}", _T.format("c_custkey")).replace("{moved}", "1998-01-01")
    + """, j AS (
  SELECT o.*, h.region_name FROM o JOIN h ON o.tenant_id = h.tenant_id AND o.customer_id = h.customer_id AND o.ordered_at >= h.valid_from AND (o.ordered_at < h.valid_to OR h.valid_to IS NULL)
  WHERE o.tenant_id = 'tenant-a' AND o.order_status = 'completed' AND NOT o.is_test AND NOT h.is_internal AND NOT h.is_test_customer),
p AS (SELECT * FROM j WHERE ordered_at >= TIMESTAMP '1997-10-01' AND ordered_at < TIMESTAMP '1998-04-01'), kept AS (SELECT * FROM p WHERE refund_status <> 'fully_refunded') """
)


def governed(spark: SparkSession, folder: str, request: Request, principal: str = "full_tenant-a") -> DataFrame:
    """The checked frame of a request on the star schema; money as decimal(38,2), buckets as dates."""
    _, df, _ = prepare(demo.catalog(), demo.policy("tenant-a", "tenant-b", "tenant-c"), principal, request, demo.star_schema(spark, folder))
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            df = df.withColumn(name, F.col(name).cast("decimal(38,2)"))
        if kind.startswith("timestamp"):
            df = df.withColumn(name, F.col(name).cast("date"))
    return df


@query(_STAR + "SELECT CAST(date_trunc('month', ordered_at) AS DATE) AS month, region_name AS region_at_order, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS revenue_usd FROM kept GROUP BY ALL")
def revenue_by_month_region(spark, folder):
    return governed(spark, folder, Request(("finance.revenue@7",), ("customer.region_at_order@2",), grain="month", **PERIOD))


@query(_STAR + "SELECT CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS revenue_usd FROM kept")
def revenue_total(spark, folder):
    return governed(spark, folder, Request(("finance.revenue",), **PERIOD))


@query(_STAR + "SELECT count(*) AS order_count FROM p")
def order_count_total(spark, folder):
    return governed(spark, folder, Request(("commerce.order_count",), **PERIOD))


@query(_STAR + "SELECT region_name AS region_at_order, round(CAST(sum(order_amount_usd) AS DOUBLE) / count(*), 6) AS average_order_usd FROM j GROUP BY ALL")
def average_order_by_region(spark, folder):
    return governed(spark, folder, Request(("commerce.average_order",), ("customer.region_at_order",))).withColumn("average_order_usd", F.round("average_order_usd", 6))


@query(_STAR + "SELECT region_name AS region_at_order, CAST(sum(order_amount_usd) FILTER (refund_status <> 'fully_refunded') AS DECIMAL(38,2)) AS revenue_usd, count(*) AS order_count FROM j GROUP BY ALL")
def revenue_and_count_by_region(spark, folder):
    return governed(spark, folder, Request(("finance.revenue", "commerce.order_count"), ("customer.region_at_order",)))


@query(_STAR + "SELECT region_name AS region_at_order, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS revenue_usd FROM kept WHERE region_name IN ('ASIA', 'EUROPE') GROUP BY ALL")
def revenue_filtered(spark, folder):
    return governed(spark, folder, Request(("finance.revenue",), ("customer.region_at_order",), filters=(("customer.region_at_order", "in", ("ASIA", "EUROPE")),), **PERIOD))


@query(_STAR + "SELECT region_name AS region_at_order, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS revenue_usd FROM kept GROUP BY ALL ORDER BY revenue_usd DESC, region_at_order LIMIT 3")
def revenue_top_regions(spark, folder):
    return governed(spark, folder, Request(("finance.revenue",), ("customer.region_at_order",), order_by=(("revenue_usd", "desc"),), limit=3, **PERIOD))


@query(_STAR + "SELECT CAST(date_trunc('month', ordered_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AS DATE) AS month, count(*) AS order_count FROM p GROUP BY ALL")
def order_count_by_local_month(spark, folder):
    return governed(spark, folder, Request(("commerce.order_count",), grain="month", timezone="America/Los_Angeles", **PERIOD))


@query(_STAR.replace("tenant_id = 'tenant-a'", "tenant_id = 'tenant-b'") + "SELECT region_name AS region_at_order, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS revenue_usd FROM kept GROUP BY ALL")
def tenant_isolation(spark, folder):
    return governed(spark, folder, Request(("finance.revenue",), ("customer.region_at_order",), **PERIOD), "full_tenant-b")


def _geographic(spark: SparkSession, folder: str, request: Request) -> DataFrame:
    _, df, _ = prepare(demo.geography(), demo.geographer(), "geographer", request, lambda id: table(spark, folder, id.removeprefix("star.")))
    return df


_GEO = "FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT r_name, count(*) AS orders_placed {_GEO} JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def governed_multi_hop(spark, folder):
    """Three joins from the orders, one of them left and one walked in reverse."""
    return _geographic(spark, folder, Request(("star.orders_placed",), ("star.r_name",)))


@query(f"SELECT n_name, c_mktsegment AS segment, max(o_totalprice) AS largest {_GEO} GROUP BY ALL")
def governed_left_join(spark, folder):
    return _geographic(spark, folder, Request(("star.largest",), ("star.n_name", "star.segment")))


@query(f"SELECT n_name, count(*) AS orders_of_large_nations {_GEO} GROUP BY n_name HAVING count(*) >= 600")
def governed_having_measure(spark, folder):
    return _geographic(spark, folder, Request(("star.orders_of_large_nations",), ("star.n_name",)))


@query(f"SELECT n_name, count(*) AS orders_of_other_nations {_GEO} GROUP BY n_name HAVING n_name <> 'NATION_7'")
def governed_having_key(spark, folder):
    return _geographic(spark, folder, Request(("star.orders_of_other_nations",), ("star.n_name",)))


@query(f"SELECT n_name, count(*) AS orders_placed {_GEO} WHERE n_name IN ('NATION_3', 'O''Brien''s  isle', 'back\\slash') AND o_totalprice >= 1000 GROUP BY n_name")
def governed_awkward_filters(spark, folder):
    """Values with quotes, two spaces, a backslash and an exponent."""
    filters = (("star.n_name", "in", ("NATION_3", "O'Brien's  isle", "back\\slash")), ("star.orders.o_totalprice", "gte", ("1e3",)))
    return _geographic(spark, folder, Request(("star.orders_placed",), ("star.n_name",), filters=filters))


def _attested(spark: SparkSession, folder: str, moved: str) -> DataFrame:
    request = Request(("commerce.order_count",), **PERIOD)
    bound = bind(demo.catalog(), demo.policy("tenant-a").scope("full_tenant-a", "demo-1"), request, "commerce.order_count")
    (_, frame), *_ = attestations(bound, demo.star_schema(spark, folder, moved=moved))
    return frame


def _attest_sql(moved: str) -> str:
    star = _STAR.replace(f"'{'1998-01-01'}', NULL", f"'{moved}', NULL")
    return star + """, n AS (
  SELECT o.order_id, count(h.tenant_id) AS n FROM o LEFT JOIN (SELECT * FROM h WHERE tenant_id = 'tenant-a') h
    ON o.tenant_id = h.tenant_id AND o.customer_id = h.customer_id AND o.ordered_at >= h.valid_from AND (o.ordered_at < h.valid_to OR h.valid_to IS NULL)
  WHERE o.tenant_id = 'tenant-a' AND o.ordered_at >= TIMESTAMP '1997-10-01' AND o.ordered_at < TIMESTAMP '1998-04-01' AND o.order_status = 'completed' AND NOT o.is_test GROUP BY o.tenant_id, o.order_id)
SELECT count(*) AS facts, CAST(coalesce(sum((n > 1)::INT), 0) AS BIGINT) AS overlapping, CAST(coalesce(sum((n = 0)::INT), 0) AS BIGINT) AS unmatched FROM n"""


@query(_attest_sql("1998-01-01"))
def attest_clean(spark, folder):
    return _attested(spark, folder, "1998-01-01")


@query(_attest_sql("1997-12-01"))
def attest_overlap(spark, folder):
    return _attested(spark, folder, "1997-12-01")


@query(_attest_sql("1998-02-01"))
def attest_gap(spark, folder):
    return _attested(spark, folder, "1998-02-01")


# Predicates, measures and buckets on the commerce tables.

_SETS = {"refund": {"all": "fully_refunded", "nothing": "none"}}


def _where(spark: SparkSession, folder: str, predicate: object) -> DataFrame:
    orders = table(spark, folder, "commerce_orders")
    ctx = Context(lambda id: orders[id], _SETS, {"p_tenant": "tenant-birch"})
    return orders.filter(ctx.predicate(predicate)).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").cast("decimal(38,0)").alias("rows"))


def _where_sql(condition: str) -> str:
    return f"SELECT tenant_id, count(*) AS n, CAST(sum(row_id) AS DECIMAL(38,0)) AS rows FROM commerce_orders WHERE {condition} GROUP BY tenant_id"


_AMOUNT, _CUSTOMER = Col("order_amount_usd"), Col("customer_id")
for _name, _tree, _condition in [
    ("pred_compare", Bool("and", (Compare("gte", _AMOUNT, Lit("100", "decimal")), Compare("lt", _AMOUNT, Lit("500.50", "decimal")))), "order_amount_usd >= 100 AND order_amount_usd < 500.50"),
    ("pred_not_equal", Compare("ne", Col("op"), Lit("insert")), "op <> 'insert'"),
    ("pred_in", In(_CUSTOMER, tuple(Lit(i, "integer") for i in range(1, 40))), "customer_id IN (SELECT unnest(range(1, 40)))"),
    ("pred_not_in", In(_CUSTOMER, (Lit(700001, "integer"), Lit(1, "integer")), True), "customer_id NOT IN (700001, 1)"),
    ("pred_not_in_null", In(_CUSTOMER, (Lit(700001, "integer"), Lit(None)), True), "customer_id NOT IN (700001, NULL)"),
    ("pred_is_null", IsNull(_CUSTOMER), "customer_id IS NULL"),
    ("pred_is_not_null", IsNull(Col("ordered_at"), True), "ordered_at IS NOT NULL"),
    ("pred_or", Bool("or", (IsNull(_CUSTOMER), Compare("lt", _CUSTOMER, Lit(0, "integer")), Compare("eq", Col("is_test"), Lit(True, "boolean")))), "customer_id IS NULL OR customer_id < 0 OR is_test"),
    ("pred_not", Bool("not", (Bool("and", (Compare("gt", _CUSTOMER, Lit(10, "integer")), Compare("eq", Col("op"), Lit("insert")))),)), "NOT (customer_id > 10 AND op = 'insert')"),
    ("pred_enum", Compare("eq", Col("refund_status"), Member("refund", "all")), "refund_status = 'fully_refunded'"),
    ("pred_parameter", Compare("eq", Col("tenant_id"), Param("p_tenant")), "tenant_id = 'tenant-birch'"),
    ("pred_half_open_period", Bool("and", (Compare("gte", Col("ordered_at"), Lit("2024-07-01T00:00:00Z", "instant")), Compare("lt", Col("ordered_at"), Lit("2024-10-01", "instant")))), "ordered_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00' AND ordered_at < TIMESTAMPTZ '2024-10-01 00:00:00+00'"),
]:
    QUERIES[_name] = lambda spark, folder, tree=_tree: _where(spark, folder, tree)
    SQL[_name] = _where_sql(_condition)


def _measures(spark: SparkSession, folder: str, **trees: object) -> DataFrame:
    orders = table(spark, folder, "commerce_orders")
    ctx = Context(lambda id: orders[id])
    return orders.groupBy("tenant_id").agg(*[ctx.measure(tree).alias(name) for name, tree in trees.items()])


@query("SELECT tenant_id, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS total, count(*) AS n, count(customer_id) AS n_named, count(DISTINCT customer_id) AS customers, round(avg(CAST(order_amount_usd AS DOUBLE)), 6) AS mean, min(order_amount_usd) AS low, max(order_amount_usd) AS high FROM commerce_orders GROUP BY tenant_id")
def aggregates_by_tenant(spark, folder):
    df = _measures(spark, folder, total=Aggregate("sum", _AMOUNT), n=Aggregate("count"), n_named=Aggregate("count", _CUSTOMER), customers=Aggregate("count_distinct", _CUSTOMER), mean=Aggregate("avg", _AMOUNT), low=Aggregate("min", _AMOUNT), high=Aggregate("max", _AMOUNT))
    return df.withColumn("total", F.col("total").cast("decimal(38,2)")).withColumn("mean", F.round("mean", 6))


_RATIO = "SELECT tenant_id, {} AS ratio FROM (SELECT tenant_id, CAST(count(customer_id) AS DOUBLE) AS a, CAST(count(CASE WHEN is_test THEN 1 END) AS DOUBLE) AS b FROM (SELECT *, customer_id % 2 = 5 AS never FROM commerce_orders) GROUP BY tenant_id)"


def _ratio(spark: SparkSession, folder: str, zero: str) -> DataFrame:
    orders = table(spark, folder, "commerce_orders").withColumn("flag", F.when(F.col("is_test"), 1))
    ctx = Context(lambda id: orders[id])
    return orders.groupBy("tenant_id").agg(F.round(ctx.measure(Ratio(Aggregate("count", _CUSTOMER), Aggregate("count", Col("flag")), zero)), 6).alias("ratio"))


@query(_RATIO.format("round(a / nullif(b, 0), 6)"))
def ratio_null(spark, folder):
    return _ratio(spark, folder, "null")


@query(_RATIO.format("round(coalesce(a / nullif(b, 0), 0), 6)"))
def ratio_zero(spark, folder):
    return _ratio(spark, folder, "zero")


_RATIO_OF = "SELECT tenant_id, customer_id, {} AS ratio FROM (SELECT tenant_id, customer_id, CAST(count(*) AS DOUBLE) AS a, CAST(count(CASE WHEN is_test THEN 1 END) AS DOUBLE) AS b FROM commerce_orders GROUP BY ALL)"


def _ratio_of(spark: SparkSession, folder: str, zero: str) -> DataFrame:
    """Orders per test order of each customer; most customers have no test order."""
    orders = table(spark, folder, "commerce_orders").withColumn("flag", F.when(F.col("is_test"), 1))
    ctx = Context(lambda id: orders[id])
    return orders.groupBy("tenant_id", "customer_id").agg(F.round(ctx.measure(Ratio(Aggregate("count"), Aggregate("count", Col("flag")), zero)), 6).alias("ratio"))


@query(_RATIO_OF.format("round(a / nullif(b, 0), 6)"))
def ratio_null_by_customer(spark, folder):
    return _ratio_of(spark, folder, "null")


@query(_RATIO_OF.format("coalesce(round(a / nullif(b, 0), 6), 0)"))
def ratio_zero_by_customer(spark, folder):
    return _ratio_of(spark, folder, "zero")


for _grain in ("day", "week", "month", "quarter", "year"):
    QUERIES[f"bucket_{_grain}"] = lambda spark, folder, grain=_grain: table(spark, folder, "commerce_orders", "ordered_at").groupBy(bucket(F.col("ordered_at"), grain).cast("date").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    SQL[f"bucket_{_grain}"] = f"SELECT CAST(date_trunc('{_grain}', ordered_at AT TIME ZONE 'UTC') AS DATE) AS bucket, count(*) AS n FROM commerce_orders GROUP BY ALL"


@query("SELECT CAST(date_trunc('day', ordered_at AT TIME ZONE 'America/New_York') AS DATE) AS bucket, count(*) AS n FROM commerce_orders GROUP BY ALL")
def bucket_new_york(spark, folder):
    return table(spark, folder, "commerce_orders", "ordered_at").groupBy(bucket(F.col("ordered_at"), "day", "America/New_York").cast("date").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tenant_id, CAST(date_trunc('quarter', (ordered_at AT TIME ZONE 'UTC') - INTERVAL 1 MONTH) + INTERVAL 1 MONTH AS DATE) AS bucket, count(*) AS n FROM commerce_orders GROUP BY ALL")
def bucket_fiscal_quarter(spark, folder):
    """Quarters of years that begin in February."""
    return table(spark, folder, "commerce_orders", "tenant_id", "ordered_at").groupBy("tenant_id", fiscal_bucket(F.col("ordered_at"), "quarter", 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT update_id, tenant_id, customer_id, op, epoch_us(changed_at) AS changed_us, region_name, is_internal, is_test_customer, epoch_us(received_at) AS received_us FROM customer_updates")
def csv_round_trip(spark, folder):
    """Rows written as CSV to the shared folder and read back."""
    updates, path = table(spark, folder, "customer_updates"), scratch(spark, "csv")
    write_csv(updates, path)
    back = read_csv(spark, path, updates.schema)
    return back.select("update_id", "tenant_id", "customer_id", "op", F.unix_micros("changed_at").alias("changed_us"), "region_name", "is_internal", "is_test_customer", F.unix_micros("received_at").alias("received_us"))


# Joins and guards against multiplying rows.


@query("SELECT o.tenant_id, count(*) AS n, count(h.customer_id) AS matched FROM (SELECT DISTINCT tenant_id, customer_id FROM commerce_orders) o LEFT JOIN (SELECT DISTINCT tenant_id, customer_id FROM commerce_customer_history) h ON o.tenant_id = h.tenant_id AND o.customer_id = h.customer_id GROUP BY o.tenant_id")
def left_join_unmatched(spark, folder):
    orders = table(spark, folder, "commerce_orders", "tenant_id", "customer_id").distinct()
    known = table(spark, folder, "commerce_customer_history", "tenant_id", F.col("customer_id").alias("known")).distinct().withColumnRenamed("tenant_id", "t")
    joined = orders.join(known, (F.col("tenant_id") == F.col("t")) & (F.col("customer_id") == F.col("known")), "left")
    return joined.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("matched"))


@query("SELECT o.tenant_id, h.region_name, count(*) AS n, CAST(sum(o.order_amount_usd) AS DECIMAL(38,2)) AS amount FROM commerce_orders o JOIN commerce_customer_history h ON o.tenant_id = h.tenant_id AND o.customer_id = h.customer_id AND o.ordered_at >= h.valid_from AND (o.ordered_at < h.valid_to OR h.valid_to IS NULL) GROUP BY ALL")
def null_open_interval_join(spark, folder):
    o, h = table(spark, folder, "commerce_orders").alias("o"), table(spark, folder, "commerce_customer_history").alias("h")
    on = (F.col("o.tenant_id") == F.col("h.tenant_id")) & (F.col("o.customer_id") == F.col("h.customer_id")) & valid_at(F.col("o.ordered_at"), F.col("h.valid_from"), F.col("h.valid_to"))
    return o.join(h, on).groupBy("o.tenant_id", "h.region_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o.order_amount_usd").cast("decimal(38,2)").alias("amount"))


@query("SELECT i.tenant_id, count(*) AS n FROM commerce_order_items i JOIN commerce_orders o ON i.tenant_id = o.tenant_id AND i.order_id = o.order_id AND i.ingested_at > o.ingested_at AND i.line_amount_usd <= o.order_amount_usd GROUP BY ALL")
def range_join(spark, folder):
    i, o = table(spark, folder, "commerce_order_items").alias("i"), table(spark, folder, "commerce_orders").alias("o")
    on = (F.col("i.tenant_id") == F.col("o.tenant_id")) & (F.col("i.order_id") == F.col("o.order_id")) & (F.col("i.ingested_at") > F.col("o.ingested_at")) & (F.col("i.line_amount_usd") <= F.col("o.order_amount_usd"))
    return i.join(o, on).groupBy("i.tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def multi_hop_region(spark, folder):
    t = lambda n: table(spark, folder, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("SELECT tenant_id, product_id, count(*) AS n, CAST(sum(line_amount_usd) AS DECIMAL(38,2)) AS amount FROM commerce_order_items GROUP BY ALL HAVING count(*) >= 10")
def having_filter(spark, folder):
    return table(spark, folder, "commerce_order_items").groupBy("tenant_id", "product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line_amount_usd").cast("decimal(38,2)").alias("amount")).filter("n >= 10")


@query("WITH o AS (SELECT tenant_id, order_id, max(order_amount_usd) AS amount FROM commerce_orders GROUP BY ALL) SELECT o.tenant_id, CAST(sum(o.amount) AS DECIMAL(38,2)) AS multiplied, CAST((SELECT sum(amount) FROM o p WHERE p.tenant_id = o.tenant_id) AS DECIMAL(38,2)) AS single FROM o JOIN commerce_order_items i ON o.tenant_id = i.tenant_id AND o.order_id = i.order_id GROUP BY o.tenant_id")
def fanout_evidence(spark, folder):
    orders = table(spark, folder, "commerce_orders").dropna(subset=["order_id"]).groupBy("tenant_id", "order_id").agg(F.max("order_amount_usd").alias("amount"))
    lines = table(spark, folder, "commerce_order_items", "tenant_id", "order_id")
    wide = orders.join(lines, ["tenant_id", "order_id"]).groupBy("tenant_id").agg(F.sum("amount").cast("decimal(38,2)").alias("multiplied"))
    return wide.join(orders.groupBy("tenant_id").agg(F.sum("amount").cast("decimal(38,2)").alias("single")), "tenant_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def grain_duplicates(spark, folder):
    return duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT tenant_id, customer_id, CAST(sum(order_amount_usd) AS DECIMAL(38,2)) AS amount FROM commerce_orders WHERE customer_id IS NOT NULL GROUP BY ALL ORDER BY amount DESC NULLS LAST, tenant_id, customer_id LIMIT 25")
def topk_customers(spark, folder):
    sums = table(spark, folder, "commerce_orders").filter("customer_id is not null").groupBy("tenant_id", "customer_id").agg(F.sum("order_amount_usd").cast("decimal(38,2)").alias("amount"))
    return sums.orderBy(F.desc_nulls_last("amount"), "tenant_id", "customer_id").limit(25)


@query("SELECT tenant_id, CAST(sum(line_amount_usd) AS DECIMAL(38,2)) AS every_line, CAST(sum(DISTINCT line_amount_usd) AS DECIMAL(38,2)) AS distinct_amounts FROM commerce_order_items GROUP BY ALL")
def equal_amounts_not_distinct(spark, folder):
    return table(spark, folder, "commerce_order_items").groupBy("tenant_id").agg(F.sum("line_amount_usd").cast("decimal(38,2)").alias("every_line"), F.sum_distinct("line_amount_usd").cast("decimal(38,2)").alias("distinct_amounts"))


# Catalog-wide work.


def _policy() -> Policy:
    grants = {"discover": ("warehouse.*",), "read": ("warehouse.commerce.*", "warehouse.finance.*"), "execute_metric": ("warehouse.*",), "disclose": ("warehouse.commerce.*",)}
    return Policy(1, {p.id: p for p in (Principal("analyst", "a", grants=grants), Principal("outsider", "b", grants={"discover": ("warehouse.support.*",)}, denies={}), Principal("restricted", "a", grants=grants, denies={"discover": ("warehouse.finance.*",), "read": ("warehouse.commerce.*",)}))})


@query(
    """WITH ids AS (SELECT DISTINCT id, CASE WHEN id LIKE 'warehouse.%' THEN split_part(id, '.', 2) END AS d FROM catalog_tables),
c AS (SELECT * FROM (VALUES ('discover'), ('read'), ('use_in_predicate'), ('execute_metric'), ('disclose')) a(action)),
p AS (SELECT * FROM (VALUES ('analyst'), ('outsider'), ('restricted')) p(principal))
SELECT principal, action, id, coalesce(d IS NOT NULL AND CASE principal WHEN 'outsider' THEN action = 'discover' AND d = 'support'
  WHEN 'analyst' THEN CASE action WHEN 'discover' THEN true WHEN 'execute_metric' THEN true WHEN 'disclose' THEN d = 'commerce' ELSE d IN ('commerce', 'finance') END
  ELSE CASE action WHEN 'discover' THEN d <> 'finance' WHEN 'execute_metric' THEN d <> 'finance' WHEN 'read' THEN false WHEN 'use_in_predicate' THEN false ELSE false END END, false) AS allowed
FROM ids, c, p WHERE id IS NOT NULL"""
)
def policy_matrix(spark, folder):
    return decisions(table(spark, folder, "catalog_tables", "id"), _policy(), id="id")


_LATEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY loaded_at DESC, record_id DESC) = 1"


@query(f"SELECT snapshot_id, id, domain FROM ({_LATEST.format('catalog_tables')}) WHERE lower(publication_status) = 'approved' AND is_certified AND len(primary_key) > 0")
def queryable_tables(spark, folder):
    return catalogs.queryable(table(spark, folder, "catalog_tables"))


@query(
    """SELECT DISTINCT 'relationship.left_table' AS "check", snapshot_id, id, lower(trim(left_table)) AS ref FROM catalog_relationships r WHERE left_table IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_tables t WHERE t.snapshot_id = r.snapshot_id AND t.id = lower(trim(r.left_table)))
UNION ALL SELECT DISTINCT 'relationship.right_table', snapshot_id, id, lower(trim(right_table)) FROM catalog_relationships r WHERE right_table IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_tables t WHERE t.snapshot_id = r.snapshot_id AND t.id = lower(trim(r.right_table)))
UNION ALL SELECT DISTINCT 'metric.base_table', snapshot_id, id, lower(trim(base_table)) FROM catalog_metrics r WHERE base_table IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_tables t WHERE t.snapshot_id = r.snapshot_id AND t.id = lower(trim(r.base_table)))
UNION ALL SELECT DISTINCT 'table.tenant_key', snapshot_id, id, lower(trim(tenant_key)) FROM catalog_tables r WHERE tenant_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_columns t WHERE t.snapshot_id = r.snapshot_id AND t.id = lower(trim(r.tenant_key)))"""
)
def publication_errors(spark, folder):
    refs = lambda name, column: table(spark, folder, name).select("snapshot_id", "id", F.lower(F.trim(column)).alias("ref"))
    ids = lambda name: table(spark, folder, name).select("snapshot_id", F.col("id").alias("ref"))
    tables = ids("catalog_tables")
    return catalogs.unresolved([("relationship.left_table", refs("catalog_relationships", "left_table"), tables), ("relationship.right_table", refs("catalog_relationships", "right_table"), tables), ("metric.base_table", refs("catalog_metrics", "base_table"), tables), ("table.tenant_key", refs("catalog_tables", "tenant_key"), ids("catalog_columns"))])


@query(
    NODES
    + """, owners AS (SELECT 'metric' AS object_type, record_id, snapshot_id, id FROM catalog_metrics UNION ALL SELECT 'rule', record_id, snapshot_id, id FROM catalog_rules UNION ALL SELECT 'relationship', record_id, snapshot_id, id FROM catalog_relationships),
named AS (
  SELECT object_type || '.' || coalesce(key, 'required_tables') AS "check", snapshot_id, id, lower(trim(v ->> '$')) AS ref, CASE WHEN key IS NULL THEN 'table' ELSE 'column' END AS target
  FROM n JOIN owners USING (object_type, record_id)
  WHERE json_type(v) = 'VARCHAR' AND ((object_type = 'relationship' AND key IN ('left_column', 'right_column')) OR (object_type <> 'relationship' AND key = 'column_ref') OR (object_type = 'rule' AND key IS NULL AND parent = 'effect.required_tables'))
  UNION ALL SELECT 'table.grain', snapshot_id, id, lower(trim(unnest(grain))), 'column' FROM catalog_tables
  UNION ALL SELECT 'table.primary_key', snapshot_id, id, lower(trim(unnest(primary_key))), 'column' FROM catalog_tables
  UNION ALL SELECT 'column.table_id', snapshot_id, id, lower(trim(table_id)), 'table' FROM catalog_columns),
held AS (SELECT 'column' AS target, snapshot_id, id AS ref FROM catalog_columns UNION SELECT 'table', snapshot_id, id FROM catalog_tables)
SELECT DISTINCT "check", snapshot_id, id, ref FROM named LEFT JOIN held USING (target, snapshot_id, ref) WHERE ref <> '' AND held.target IS NULL"""
)
def publication_errors_nested(spark, folder):
    """Columns and tables that nested texts, grains, keys and columns name and their snapshot lacks."""
    tables, columns = table(spark, folder, "catalog_tables"), table(spark, folder, "catalog_columns", "snapshot_id", "id", "table_id")
    owners = {"metric": table(spark, folder, "catalog_metrics"), "rule": table(spark, folder, "catalog_rules"), "relationship": table(spark, folder, "catalog_relationships")}
    named = catalogs.mentions(_flat(spark, folder, ("string",)), owners).unionByName(catalogs.table_mentions(tables, columns))
    targets = [df.select(F.lit(kind).alias("target"), "snapshot_id", F.col("id").alias("ref")) for kind, df in (("column", columns), ("table", tables))]
    return catalogs.unresolved_mentions(named, targets[0].unionByName(targets[1]))


@query(
    NODES
    + f""", bad AS (
  SELECT 'column.parent' AS "check", snapshot_id, record_id FROM catalog_columns WHERE regexp_replace(lower(trim(id)), '\\.[^.]*$', '') IS DISTINCT FROM lower(trim(table_id))
  UNION ALL SELECT 'table.identifier', snapshot_id, record_id FROM catalog_tables WHERE NOT coalesce(regexp_matches(physical.database, '{catalogs.IDENTIFIER}') AND regexp_matches(physical.schema_name, '{catalogs.IDENTIFIER}') AND regexp_matches(physical.name, '{catalogs.IDENTIFIER}'), false)
  UNION ALL SELECT 'table.key_of_other_table', snapshot_id, record_id FROM catalog_tables WHERE len(list_filter(list_concat(coalesce(grain, []), coalesce(primary_key, [])), lambda c: regexp_replace(lower(trim(c)), '\\.[^.]*$', '') <> lower(trim(id)))) > 0
  UNION ALL SELECT 'relationship.not_temporal', snapshot_id, record_id FROM catalog_relationships WHERE is_temporal AND record_id NOT IN (SELECT record_id FROM n WHERE object_type = 'relationship' AND key = 'op' AND json_type(v) = 'VARCHAR' AND lower(v ->> '$') IN {catalogs.ORDERINGS}))
SELECT * FROM bad"""
)
def record_errors(spark, folder):
    """Catalog records that contradict themselves."""
    read = lambda name: table(spark, folder, name)
    return catalogs.invalid_records(read("catalog_tables"), read("catalog_columns"), read("catalog_relationships"), _flat(spark, folder, ("string",)))


@query(
    """WITH RECURSIVE nodes AS (SELECT DISTINCT snapshot_id, lower(trim(id) || '@' || version) AS ref FROM catalog_metrics),
named AS (SELECT DISTINCT snapshot_id, ref, lower(trim(d)) AS "on" FROM (SELECT snapshot_id, lower(trim(id) || '@' || version) AS ref, unnest(dependency_refs) AS d FROM catalog_metrics)),
edges AS (SELECT e.* FROM named e SEMI JOIN nodes n ON e.snapshot_id = n.snapshot_id AND e."on" = n.ref),
paths AS (SELECT snapshot_id, ref, 0 AS l FROM nodes UNION SELECT e.snapshot_id, e.ref, l + 1 FROM paths p JOIN edges e ON e.snapshot_id = p.snapshot_id AND e."on" = p.ref WHERE l <= (SELECT count(*) FROM edges))
SELECT snapshot_id, ref, CASE WHEN max(l) <= (SELECT count(*) FROM edges) THEN max(l) END AS level, max(l) > (SELECT count(*) FROM edges) AS cyclic FROM paths WHERE ref IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY ALL"""
)
def metric_levels(spark, folder):
    """How deep metrics are built from metrics, and whether in a circle."""
    return catalogs.dependency_levels(table(spark, folder, "catalog_metrics", "snapshot_id", "id", "version", "dependency_refs"))


_CLOSURE = (
    NODES
    + """, named AS (
  SELECT DISTINCT m.snapshot_id, m.id, m.version, lower(trim(v ->> '$')) AS column_id, CASE WHEN field = 'expression' THEN 'measure' ELSE 'population' END AS part
  FROM n JOIN catalog_metrics m USING (record_id) WHERE object_type = 'metric' AND key = 'column_ref' AND json_type(v) = 'VARCHAR'),
closure AS (SELECT *, regexp_replace(column_id, '\\.[^.]*$', '') AS table_id FROM named)"""
)


def _closure(spark: SparkSession, folder: str) -> DataFrame:
    values = _flat(spark, folder, ("string",)).filter("object_type = 'metric'")
    return catalogs.metric_closure(values, table(spark, folder, "catalog_metrics"))


@query(_CLOSURE + " SELECT snapshot_id, id, version, count(DISTINCT column_id) AS n_columns, count(DISTINCT table_id) AS n_tables, CAST(sum((part = 'measure')::INT) AS BIGINT) AS n_measure FROM closure GROUP BY ALL")
def metric_closures(spark, folder):
    return _closure(spark, folder).groupBy("snapshot_id", "id", "version").agg(F.count_distinct("column_id").alias("n_columns"), F.count_distinct("table_id").alias("n_tables"), F.sum((F.col("part") == "measure").cast("long")).alias("n_measure"))


@query(
    _CLOSURE
    + """, a AS (
  SELECT record_id, max(CASE WHEN key = 'op' THEN lower(v ->> '$') END) AS op, max(CASE WHEN key = 'object_id' THEN lower(v ->> '$') END) AS object_id
  FROM n WHERE object_type = 'rule' AND field = 'activation' AND parent = 'activation' AND json_type(v) = 'VARCHAR' GROUP BY record_id),
r AS (SELECT DISTINCT snapshot_id, id AS rule_id, op, object_id FROM a JOIN catalog_rules USING (record_id))
SELECT DISTINCT c.snapshot_id, c.id AS metric_id, r.rule_id FROM closure c JOIN r ON r.snapshot_id = c.snapshot_id AND ((r.op = 'uses_column' AND r.object_id = c.column_id) OR (r.op = 'uses_table' AND r.object_id = c.table_id))"""
)
def rules_by_metric(spark, folder):
    values = _flat(spark, folder, ("string",)).filter("object_type = 'rule'")
    return catalogs.activated_rules(_closure(spark, folder), values, table(spark, folder, "catalog_rules"))


# What the two queries above leave out by their SQL: base tables, tags, metrics that rules name.
_TABLES = _CLOSURE + """, reached AS (SELECT snapshot_id, id, version, table_id FROM closure UNION SELECT snapshot_id, id, version, lower(trim(base_table)) FROM catalog_metrics WHERE base_table IS NOT NULL)"""


@query(
    _TABLES
    + """, c AS (SELECT snapshot_id, id, version, count(DISTINCT column_id) AS n_columns, sum((part = 'measure')::INT) AS n_measure FROM closure GROUP BY ALL),
t AS (SELECT snapshot_id, id, version, count(DISTINCT table_id) AS n_tables FROM reached GROUP BY ALL)
SELECT snapshot_id, id, version, coalesce(n_columns, 0) AS n_columns, n_tables, CAST(coalesce(n_measure, 0) AS BIGINT) AS n_measure FROM t LEFT JOIN c USING (snapshot_id, id, version)"""
)
def metric_closures_with_base(spark, folder):
    closure = _closure(spark, folder)
    counts = closure.groupBy(*catalogs.PINNED).agg(F.count_distinct("column_id").alias("n_columns"), F.sum((F.col("part") == "measure").cast("long")).alias("n_measure"))
    reached = catalogs.metric_tables(closure, table(spark, folder, "catalog_metrics")).groupBy(*catalogs.PINNED).agg(F.count("table_id").alias("n_tables"))
    return reached.join(counts, catalogs.PINNED, "left").fillna(0, ["n_columns", "n_measure"]).select(*catalogs.PINNED, "n_columns", "n_tables", "n_measure")


@query(
    _TABLES
    + f""", a AS (
  SELECT record_id, max(CASE WHEN key = 'op' THEN lower(trim(v ->> '$')) END) AS op, max(CASE WHEN key = 'object_id' THEN lower(trim(v ->> '$')) END) AS object_id,
         max(CASE WHEN key = 'tag' THEN lower(trim(v ->> '$')) END) AS tag, max(CASE WHEN key = 'metric_ref' THEN lower(trim(v ->> '$')) END) AS metric_ref
  FROM n WHERE object_type = 'rule' AND field = 'activation' AND parent = 'activation' AND json_type(v) = 'VARCHAR' GROUP BY record_id),
r AS (SELECT DISTINCT snapshot_id, id AS rule_id, op, object_id, tag, metric_ref FROM a JOIN catalog_rules USING (record_id)),
g AS (SELECT DISTINCT m.snapshot_id, m.id, lower(trim(tag)) AS tag FROM reached m JOIN (SELECT snapshot_id, id, unnest(tags) AS tag FROM ({_LATEST.format('catalog_tables')})) t ON t.snapshot_id = m.snapshot_id AND lower(trim(t.id)) = m.table_id)
SELECT c.snapshot_id, c.id AS metric_id, r.rule_id FROM closure c JOIN r ON r.snapshot_id = c.snapshot_id AND r.op = 'uses_column' AND r.object_id = c.column_id
UNION SELECT c.snapshot_id, c.id, r.rule_id FROM reached c JOIN r ON r.snapshot_id = c.snapshot_id AND r.op = 'uses_table' AND r.object_id = c.table_id
UNION SELECT g.snapshot_id, g.id, r.rule_id FROM g JOIN r ON r.snapshot_id = g.snapshot_id AND r.op = 'any_scan_with_tag' AND r.tag = g.tag
UNION SELECT m.snapshot_id, m.id, r.rule_id FROM catalog_metrics m JOIN r ON r.snapshot_id = m.snapshot_id AND r.op = 'uses_metric' AND r.metric_ref IN (lower(trim(m.id)), lower(trim(m.id)) || '@' || m.version)"""
)
def rules_by_metric_decidable(spark, folder):
    values = _flat(spark, folder, ("string",)).filter("object_type = 'rule'")
    t = lambda n: table(spark, folder, n)
    return catalogs.decidable_rules(_closure(spark, folder), values, t("catalog_rules"), t("catalog_metrics"), t("catalog_tables"))


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    return catalogs.cards(t("catalog_tables"), t("catalog_columns"), t("catalog_metrics"), t("catalog_relationships"))


@query(
    " UNION ALL ".join(f"SELECT '{kind}' AS object_type, count(DISTINCT id) AS n FROM catalog_{kind}s WHERE snapshot_id = 'year-end'" for kind in ("table", "column", "metric", "relationship"))
)
def indexed_cards(spark, folder):
    """The cards of one snapshot as its index on shared storage serves them."""
    index = CardIndex(spark, scratch(spark, "index"))
    index.index(_cards(spark, folder), "year-end")
    return index.read("year-end").groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT object_type, domain, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT chunk_id) AS chunks FROM (
SELECT 'table' AS object_type, domain, concat_ws(' ', 'table', name, domain, array_to_string(tags, ' ')) AS content, left(sha256(concat_ws('|', snapshot_id, 'table', id)), 10) AS chunk_id FROM ({_LATEST.format('catalog_tables')})
UNION ALL SELECT 'column', domain, concat_ws(' ', 'column', name, data_type, coalesce(array_to_string(synonyms, ' '), ''), unit, classification), left(sha256(concat_ws('|', snapshot_id, 'column', id)), 10) FROM ({_LATEST.format('catalog_columns')})
UNION ALL SELECT 'metric', domain, concat_ws(' ', 'metric', id, unit), left(sha256(concat_ws('|', snapshot_id, 'metric', id)), 10) FROM ({_LATEST.format('catalog_metrics')})
UNION ALL SELECT 'relationship', domain, concat_ws(' ', 'relationship', left_table, right_table, cardinality), left(sha256(concat_ws('|', snapshot_id, 'relationship', id)), 10) FROM ({_LATEST.format('catalog_relationships')})) GROUP BY ALL"""
)
def search_cards(spark, folder):
    return _cards(spark, folder).groupBy("object_type", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.count_distinct("chunk_id").alias("chunks"))


@query(
    f"""WITH c AS (SELECT 'table' AS object_type, snapshot_id, id, domain, access_scope, name FROM ({_LATEST.format('catalog_tables')})
UNION ALL SELECT 'column', snapshot_id, id, domain, access_scope, name FROM ({_LATEST.format('catalog_columns')}))
SELECT object_type, domain, access_scope, count(*) AS n FROM c WHERE snapshot_id = 'year-end' AND domain IN ('commerce', 'finance') AND (access_scope IS NULL OR access_scope IN ('all', 'commerce-readers')) AND id NOT LIKE 'warehouse.finance.%' GROUP BY ALL"""
)
def permitted_cards(spark, folder):
    reader = Principal("reader", "a", frozenset({"commerce", "finance"}), frozenset({"all", "commerce-readers"}), denies={"discover": ("warehouse.finance.*",)})
    return retrieval.permitted(_cards(spark, folder), reader, "year-end", types=["table", "column"]).groupBy("object_type", "domain", "access_scope").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS ({_LATEST.format('catalog_tables')}), c AS ({_LATEST.format('catalog_columns')}), r AS ({_LATEST.format('catalog_rules')}),
cards AS (
SELECT 'rule' AS object_type, snapshot_id, id, concat_ws(' ', 'rule', id, rule_class, failure) AS content FROM r
UNION ALL SELECT 'domain', snapshot_id, domain, concat_ws(' ', 'domain', domain, coalesce(string_agg(DISTINCT name, ' ' ORDER BY name), '')) FROM t WHERE trim(domain) <> '' GROUP BY snapshot_id, domain
UNION ALL SELECT 'term', snapshot_id, term, concat_ws(' ', 'term', term, string_agg(DISTINCT id, ' ' ORDER BY id)) FROM (SELECT snapshot_id, id, lower(trim(unnest(synonyms))) AS term FROM c) WHERE term <> '' GROUP BY snapshot_id, term)
SELECT object_type, snapshot_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT left(sha256(concat_ws('|', snapshot_id, object_type, id)), 10)) AS chunks FROM cards GROUP BY ALL"""
)
def rule_domain_term_cards(spark, folder):
    t = lambda n: table(spark, folder, n)
    made = catalogs.more_cards(t("catalog_tables"), t("catalog_columns"), t("catalog_rules"))
    return made.groupBy("object_type", "snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.count_distinct("chunk_id").alias("chunks"))


@query("SELECT count(*) AS n FROM catalog_tables WHERE id NOT LIKE 'warehouse.finance.%' AND id NOT LIKE 'warehouse.people.%'")
def deny_prefix_filter(spark, folder):
    denied = spark.createDataFrame([("warehouse.finance",), ("warehouse.people",)], "id string")
    return retrieval.visible(table(spark, folder, "catalog_tables"), denied, id="id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n.word, count(DISTINCT c.id) AS refs FROM (SELECT DISTINCT upper(name) AS word FROM catalog_columns) n JOIN (SELECT id, unnest(synonyms) AS s FROM catalog_columns) c ON lower(trim(n.word)) = lower(trim(c.s)) GROUP BY n.word")
def term_lookup(spark, folder):
    columns = table(spark, folder, "catalog_columns")
    terms = columns.select(F.explode("synonyms").alias("term"), F.col("id").alias("ref")).distinct()
    words = columns.select(F.upper("name").alias("word")).distinct()
    return retrieval.lookup_terms(terms, words).groupBy("word").agg(F.count(F.lit(1)).alias("refs"))


# Search over documents and vectors: every row whose id is divisible by 100 is a query.


@query("SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))) AS BIGINT) AS tokens FROM documents GROUP BY ALL")
def tokenize_counts(spark, folder):
    return table(spark, folder, "documents", "lang", "text").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))


@query("SELECT doc_id, left(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), title)), 10) AS chunk_id, length(left(text, 600)) AS n FROM documents")
def excerpts(spark, folder):
    return table(spark, folder, "documents", "doc_id", "title", "text").select("doc_id", short_id(F.col("doc_id").cast("string"), F.col("title")).alias("chunk_id"), F.length(excerpt(F.col("text"))).cast("long").alias("n"))


_BM25 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM d),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]+')) AS token FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL),
p AS (SELECT doc_id, len_, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len_, unnest(toks) AS token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_ / al))), 6) AS score
  FROM p JOIN f USING (token) JOIN q USING (token), s GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20)"""


def _bm25(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "title", "text")
    queries = documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return retrieval.bm25(documents, queries, doc_id="doc_id", text="text", k=20)


@query(_BM25 + " SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM bm WHERE rank <= 5")
def bm25_documents(spark, folder):
    return _bm25(spark, folder).filter("rank <= 5").select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "title")
    queries = documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return retrieval.bm25(documents, queries, doc_id="doc_id", text="title", k=20)


_RRF = (
    _BM25
    + r""", dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]+') AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM dt),
pt AS (SELECT doc_id, len_, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len_, unnest(toks) AS token FROM dt) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
ft AS (SELECT token, count(*) AS df FROM pt GROUP BY ALL),
scored_t AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_ / al))), 6) AS score FROM pt JOIN ft USING (token) JOIN q USING (token), st GROUP BY ALL),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored_t WHERE score > 0 QUALIFY rank <= 20),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM bt) GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""
)


@query(_RRF + " SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM rrf WHERE rank <= 10")
def rrf_title_and_text(spark, folder):
    return retrieval.fuse(_titles(spark, folder), _bm25(spark, folder), k=10).select("query_id", "doc_id", "score", "rank")


@query(
    _RRF
    + """, c AS (SELECT query_id, doc_id, page_id, r.rank AS old FROM rrf r JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY r.rank) <= 3),
n AS (SELECT query_id, doc_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY old) AS INT) AS rank FROM c) SELECT * FROM n WHERE rank <= 10"""
)
def rrf_capped_per_page(spark, folder):
    fused = retrieval.fuse(_titles(spark, folder), _bm25(spark, folder))
    pages = table(spark, folder, "documents", "doc_id", "page_id")
    return retrieval.cap_per_source(fused.join(pages, "doc_id"), source="page_id").filter("rank <= 10").select("query_id", "doc_id", "page_id", "rank")


# The two queries above fuse the best 20 of each branch, as their SQL says; these fuse whole rankings.
_WHOLE_RRF = _RRF.replace(" QUALIFY rank <= 20", "")


def _whole_fused(spark: SparkSession, folder: str, k: int | None = None) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "title", "text")
    queries = documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    branches = [retrieval.top(retrieval.bm25(documents, queries, doc_id="doc_id", text=field, k=None), None) for field in ("title", "text")]
    return retrieval.fuse(*branches, k=k)


@query(_WHOLE_RRF + " SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM rrf WHERE rank <= 10")
def rrf_whole_title_and_text(spark, folder):
    return _whole_fused(spark, folder, k=10).select("query_id", "doc_id", "score", "rank")


@query(
    _WHOLE_RRF
    + """, c AS (SELECT query_id, doc_id, page_id, r.rank AS old FROM rrf r JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY r.rank) <= 3),
n AS (SELECT query_id, doc_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY old) AS INT) AS rank FROM c) SELECT * FROM n WHERE rank <= 10"""
)
def rrf_whole_capped_per_page(spark, folder):
    pages = table(spark, folder, "documents", "doc_id", "page_id")
    return retrieval.cap_per_source(_whole_fused(spark, folder).join(pages, "doc_id"), source="page_id").filter("rank <= 10").select("query_id", "doc_id", "page_id", "rank")


@query(_RRF + """, every AS (SELECT query_id, doc_id, score FROM scored WHERE score > 0 UNION ALL SELECT query_id, doc_id, score * 2.0 FROM scored_t WHERE score > 0),
both_ AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM every GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM both_)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5""")
def bm25_boosted_title(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "title", "text")
    queries = documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    found = retrieval.bm25_fields(documents, queries, doc_id="doc_id", fields={"title": 2.0, "text": 1.0}, k=5)
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.e, v.e), 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank
  FROM v q, v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10) SELECT query_id, doc_id, score, rank FROM s"""
)
def cosine_embeddings(spark, folder):
    vectors = retrieval.usable_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"), vector="embedding", size=64)
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.cosine(vectors, queries, doc_id="vec_id", vector="embedding", k=10)
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_NEAR = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)), 6) AS score
  FROM v q, v d WHERE q.vec_id % 100 = 0),
"""


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All usable vectors, and the query set: ids divisible by 100."""
    vectors = retrieval.usable_vectors(table(spark, folder, "embeddings"), vector="embedding", size=64)
    return vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.filter(F.col("rank") <= k).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_TOP = " SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= "


@query(_NEAR + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE label % 2 = 0)" + _TOP + "5")
def cosine_with_filter(spark, folder):
    """Nearest neighbours among vectors of even labels: the filter comes before the ranking."""
    vectors, queries = _vectors(spark, folder)
    return _ranked(retrieval.cosine(vectors.filter("label % 2 = 0"), queries, doc_id="vec_id", vector="embedding", k=5), 5)


@query(
    _NEAR + """h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 20),
r AS (SELECT h.query_id, h.doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY (h.label = q.label)::INT + h.score DESC, h.doc_id) AS rank FROM h JOIN v q ON q.vec_id = h.query_id)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10"""
)
def reranked_by_label(spark, folder):
    """The best 20 by similarity, ranked again with those of the query's label first."""
    vectors, queries = _vectors(spark, folder)
    hits = retrieval.cosine(vectors, queries, doc_id="vec_id", vector="embedding", k=20)
    labels = vectors.select(F.col("vec_id").alias("doc_id"), "label").join(hits, "doc_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    scores = labels.select("query_id", "doc_id", ((F.col("label") == F.col("own")).cast("int") + F.col("score")).alias("score"))
    return retrieval.rerank(hits, scores, k=10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT query_id, CASE n WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'failed' END AS status FROM (
SELECT doc_id AS query_id, (len(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]+')) > 0)::INT + EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND len(e.embedding) = 64)::INT AS n FROM documents d WHERE doc_id % 100 = 0)"""
)
def search_completion(spark, folder):
    """Which searches both branches can serve: words of the title, a vector of the document."""
    queries = table(spark, folder, "documents", F.col("doc_id").alias("query_id"), "title").filter("query_id % 100 = 0")
    _, vectors = _vectors(spark, folder)
    return retrieval.completion(queries, [queries.filter(F.size(tokens(F.col("title"))) > 0), vectors])


_COLUMN_CARDS = (
    f"""WITH cards AS (SELECT id, lower(trim(table_id)) AS table_id, snapshot_id, concat_ws(' ', 'column', name, data_type, coalesce(array_to_string(synonyms, ' '), ''), unit, classification) AS content FROM ({_LATEST.format('catalog_columns')})),
d AS (SELECT c.id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS toks, snapshot_id = 'year-end' AND table_id IN (SELECT id FROM ({_LATEST.format('catalog_tables')}) t WHERE t.snapshot_id = 'year-end' AND domain = 'commerce') AS kept FROM cards c WHERE snapshot_id = 'year-end'),
s AS (SELECT avg(len(toks)) AS al, count(*) FILTER (kept) AS n FROM d),
q AS (SELECT 'amount' AS query_id, 'amount' AS token UNION ALL SELECT 'amount', 'decimal' UNION ALL SELECT 'when', 'timestamptz'),
p AS (SELECT id, len_, token, count(*) AS tf FROM (SELECT id, len(toks) AS len_, unnest(toks) AS token FROM d WHERE kept) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY ALL),
scored AS (SELECT query_id, id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_ / al))), 6) AS score FROM p JOIN f USING (token) JOIN q USING (token), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 15)"""
)


def _column_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Columns by keywords, within the tables of one domain; statistics of length are those of the snapshot."""
    columns = table(spark, folder, "catalog_columns").filter("snapshot_id = 'year-end'")
    tables = catalogs.latest(table(spark, folder, "catalog_tables").filter("snapshot_id = 'year-end'"), "domain").filter("domain = 'commerce'").select(F.col("id").alias("table_id"), F.lit(True).alias("within"))
    made = catalogs.column_cards(columns).join(tables, "table_id", "left").withColumn("within", F.coalesce("within", F.lit(False)))
    queries = spark.createDataFrame([("amount", "amount decimal"), ("when", "timestamptz")], "query_id string, text string")
    return retrieval.bm25(made, queries, doc_id="id", text="content", keep="within", k=15)


@query(_COLUMN_CARDS + " SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM r")
def columns_of_tables(spark, folder):
    return _ranked(_column_hits(spark, folder), 15)


@query(
    _COLUMN_CARDS + """, k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE doc_id NOT LIKE 'warehouse.commerce.route%')
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM k"""
)
def authorized_after_ranking(spark, folder):
    """The same hits checked once more against denied tables, and ranked anew."""
    hits = _column_hits(spark, folder)
    denied = table(spark, folder, "catalog_tables", "id").distinct().filter("id like 'warehouse.commerce.route%'")
    kept, _ = retrieval.authorized_hits(hits, denied)
    return _ranked(kept, 15)


@query("SELECT label, count(*) AS n, count(DISTINCT len(embedding)) AS sizes FROM embeddings GROUP BY label")
def embedding_sizes(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("sizes"))


# Larger shapes.


@query("SELECT user_id, a.n_events, b.n_orders, b.amount FROM (SELECT user_id, count(*) AS n_events FROM events GROUP BY ALL) a FULL JOIN (SELECT o_custkey AS user_id, count(*) AS n_orders, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL) b USING (user_id)")
def multi_fact_full_outer(spark, folder):
    events = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    return analytics.multi_fact([events, orders], ["user_id"])


@query("SELECT tenant_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, customer_id FROM commerce_orders) o WHERE EXISTS (SELECT 1 FROM commerce_customer_history h WHERE h.tenant_id = o.tenant_id AND h.customer_id = o.customer_id AND h.is_internal) GROUP BY ALL")
def exists_population(spark, folder):
    internal = table(spark, folder, "commerce_customer_history").filter("is_internal")
    return table(spark, folder, "commerce_orders", "tenant_id", "customer_id").distinct().join(internal, ["tenant_id", "customer_id"], "left_semi").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS p FROM orders), f AS (SELECT *, min(p) OVER (PARTITION BY u) AS cohort FROM a),
c AS (SELECT cohort, date_diff('month', cohort, p) AS period, count(*) AS active FROM f GROUP BY ALL), s AS (SELECT cohort, active AS size FROM c WHERE period = 0)
SELECT CAST(s.cohort AS DATE) AS cohort, CAST(g.period AS INT) AS period, size, coalesce(active, 0) AS active, round(100.0 * coalesce(active, 0) / size, 2) AS percent FROM s CROSS JOIN (SELECT unnest(range(0, 4)) AS period) g LEFT JOIN c ON c.cohort = s.cohort AND c.period = g.period"""
)
def cohort_retention(spark, folder):
    return analytics.retention(table(spark, folder, "orders"), user="o_custkey", at="o_orderdate").withColumn("cohort", F.col("cohort").cast("date"))


_RANKS = {"rank": "rank()", "dense_rank": "dense_rank()"}
for _ties, _sql in _RANKS.items():
    QUERIES[f"top_customers_{_ties}"] = lambda spark, folder, ties=_ties: analytics.ranked(
        table(spark, folder, "commerce_orders").filter("customer_id is not null").groupBy("tenant_id", "customer_id").agg(F.count(F.lit(1)).alias("n")), by=["tenant_id"], order=[F.desc("n")], n=3, ties=ties
    ).select("tenant_id", "customer_id", "n", F.col("position").cast("long").alias("position"))
    SQL[f"top_customers_{_ties}"] = f"SELECT tenant_id, customer_id, n, position FROM (SELECT tenant_id, customer_id, n, {_sql} OVER (PARTITION BY tenant_id ORDER BY n DESC) AS position FROM (SELECT tenant_id, customer_id, count(*) AS n FROM commerce_orders WHERE customer_id IS NOT NULL GROUP BY ALL)) WHERE position <= 3"


def _by_month(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "commerce_orders").filter("ordered_at is not null").groupBy("tenant_id", F.date_trunc("month", "ordered_at").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_MONTHS = "m AS (SELECT tenant_id, CAST(date_trunc('month', ordered_at AT TIME ZONE 'UTC') AS DATE) AS month, count(*) AS n FROM commerce_orders WHERE ordered_at IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_MONTHS} SELECT tenant_id, month, n, lag(n) OVER w AS before, n - lag(n) OVER w AS change, round(100.0 * (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0), 2) AS percent FROM m WINDOW w AS (PARTITION BY tenant_id ORDER BY month)")
def period_over_period(spark, folder):
    return analytics.period_change(_by_month(spark, folder), keys=["tenant_id"], bucket="month", value="n")


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY user_id) SELECT user_id, day, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (user_id, day)")
def time_spine_fill(spark, folder):
    days = table(spark, folder, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return analytics.spine(days, keys=["user_id"], bucket="day", step="1 day", fill={"n": 0})


@query(
    """WITH s0 AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY ALL), s1 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s0 USING (user_id) WHERE event_type = 'view' AND e.ts >= s0.t GROUP BY ALL),
s2 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s1 USING (user_id) WHERE event_type = 'click' AND e.ts >= s1.t GROUP BY ALL), s3 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s2 USING (user_id) WHERE event_type = 'purchase' AND e.ts >= s2.t GROUP BY ALL)
SELECT 1 AS step, 'signup' AS name, count(*) AS users FROM s0 UNION ALL SELECT 2, 'view', count(*) FROM s1 UNION ALL SELECT 3, 'click', count(*) FROM s2 UNION ALL SELECT 4, 'purchase', count(*) FROM s3"""
)
def funnel_events(spark, folder):
    return analytics.funnel(table(spark, folder, "events"), user="user_id", at="ts", kind="event_type", steps=["signup", "view", "click", "purchase"])


@query("WITH l AS (SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) SELECT event_type, round(sum(v), 4) AS value, count(*) AS n FROM l GROUP BY ALL")
def semi_additive_latest(spark, folder):
    return analytics.latest_then_sum(table(spark, folder, "events"), entity=["user_id"], keys=["event_type"], at=["ts", "event_id"], value="value").withColumn("value", F.round("value", 4))


@query(
    """WITH o AS (SELECT tenant_id, order_id, max(order_amount_usd) AS amount FROM commerce_orders WHERE order_id IS NOT NULL GROUP BY ALL), t AS (SELECT tenant_id, order_id, CAST(sum(line_amount_usd) AS DOUBLE) AS total, count(*) AS k FROM commerce_order_items GROUP BY ALL)
SELECT i.tenant_id, count(*) AS n, round(sum(CAST(o.amount AS DOUBLE) * CASE WHEN total <> 0 THEN CAST(line_amount_usd AS DOUBLE) / total ELSE 1.0 / k END), 0) AS allocated
FROM commerce_order_items i JOIN t ON i.tenant_id = t.tenant_id AND i.order_id = t.order_id JOIN o ON i.tenant_id = o.tenant_id AND i.order_id = o.order_id GROUP BY ALL"""
)
def allocated_order_amounts(spark, folder):
    orders = table(spark, folder, "commerce_orders").dropna(subset=["order_id"]).groupBy("tenant_id", "order_id").agg(F.max("order_amount_usd").alias("amount"))
    lines = table(spark, folder, "commerce_order_items", "tenant_id", "order_id", F.col("line_amount_usd").cast("double").alias("weight"))
    shares = analytics.allocate(orders, lines, key=["tenant_id", "order_id"], amount="amount", weight="weight")
    return shares.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("allocated"), 0).alias("allocated"))

