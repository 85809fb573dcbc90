"""A small published catalog over orders and customer history, with principals and resolvers."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplan.functions.expressions import Aggregate, Bool, Col, Compare, Lit, Member, Ratio
from lodeplan.plans.catalog import Catalog, Column, Dimension, Edge, Metric, Rule, Table, Term, ValueSet
from lodeplan.plans.frames import Resolver
from lodeplan.plans.policy import Policy, Principal
from lodeplan.sources.tables import table

ORDERS, HISTORY, ITEMS = "warehouse.commerce.orders", "warehouse.commerce.customer_history", "warehouse.commerce.order_items"
STATUS, REFUND = "commerce.order_status", "commerce.refund_status"


def _columns(table_id: str, *specs: str) -> list[Column]:
    """``name type [role]`` per column."""
    out = []
    for spec in specs:
        name, data_type, *role = spec.split()
        sets = {"order_status": STATUS, "refund_status": REFUND}
        out.append(Column(id=f"{table_id}.{name}", table=table_id, name=name, data_type=data_type, time_role=role[0] if role else None, value_set=sets.get(name)))
    return out


# Ids, versions, members and rule names of the demo catalog, which published answers rest on.
def catalog(snapshot_id: str = "demo-1") -> Catalog:
    o, h, i = (lambda n: f"{ORDERS}.{n}"), (lambda n: f"{HISTORY}.{n}"), (lambda n: f"{ITEMS}.{n}")
    completed = Compare("eq", Col(o("order_status")), Member(STATUS, "completed"))
    real = Compare("eq", Col(o("is_test")), Lit(False, "boolean"))
    kept = Compare("ne", Col(o("refund_status")), Member(REFUND, "fully_refunded"))
    grains = ("day", "month", "quarter", "year")
    dimensions = ("customer.region_at_order", "commerce.status")
    records = [
        Table(id=ORDERS, physical="commerce.orders", grain=(o("tenant_id"), o("order_id")), tenant_key=o("tenant_id"), certified=True, tags=("tenant_scoped", "fact")),
        Table(id=HISTORY, physical="commerce.customer_history", grain=(h("tenant_id"), h("customer_id"), h("valid_from")), tenant_key=h("tenant_id"), certified=True, tags=("tenant_scoped",)),
        Table(id=ITEMS, physical="commerce.order_items", grain=(i("tenant_id"), i("order_id"), i("line_number")), tenant_key=i("tenant_id"), tags=("tenant_scoped", "fact")),
        *_columns(ORDERS, "tenant_id VARCHAR", "order_id BIGINT", "customer_id BIGINT", "ordered_at TIMESTAMP event", "order_amount_usd DECIMAL", "order_status VARCHAR", "is_test BOOLEAN", "refund_status VARCHAR"),
        *_columns(HISTORY, "tenant_id VARCHAR", "customer_id BIGINT", "valid_from TIMESTAMP validity_start", "valid_to TIMESTAMP validity_end", "region_name VARCHAR", "is_internal BOOLEAN", "is_test_customer BOOLEAN"),
        *_columns(ITEMS, "tenant_id VARCHAR", "order_id BIGINT", "line_number INTEGER", "product_id BIGINT", "line_amount_usd DECIMAL"),
        Edge(id="commerce.orders_customers_asof", version=2, left=ORDERS, right=HISTORY, cardinality="many_to_one", attested=True,
             predicates=(("eq", o("tenant_id"), h("tenant_id")), ("eq", o("customer_id"), h("customer_id")), ("gte", o("ordered_at"), h("valid_from")), ("lt_or_null", o("ordered_at"), h("valid_to")))),
        Edge(id="commerce.orders_items", version=2, left=ORDERS, right=ITEMS, cardinality="one_to_many", prohibited=("additive_measure",),
             predicates=(("eq", o("tenant_id"), i("tenant_id")), ("eq", o("order_id"), i("order_id")))),
        ValueSet(id=STATUS, members={"completed": "completed", "pending": "pending", "cancelled": "cancelled"}),
        ValueSet(id=REFUND, members={"none": "none", "partially_refunded": "partially_refunded", "fully_refunded": "fully_refunded"}),
        Metric(id="finance.revenue", version=7, name="Revenue", aliases=("sales",), unit="usd", base_table=ORDERS, expression=Aggregate("sum", Col(o("order_amount_usd"))), population=Bool("and", (completed, real, kept)),
               time_column=o("ordered_at"), grains=grains, dimensions=dimensions, required_rules=("global.exclude_internal_customers@2",), entity="customer"),
        Metric(id="commerce.order_count", name="Order count", aliases=("orders",), base_table=ORDERS, expression=Aggregate("count"), population=Bool("and", (completed, real)), time_column=o("ordered_at"), grains=grains, dimensions=dimensions, entity="customer"),
        Metric(id="commerce.average_order", name="Average order", unit="usd", base_table=ORDERS, expression=Ratio(Aggregate("sum", Col(o("order_amount_usd"))), Aggregate("count")), population=Bool("and", (completed, real)), time_column=o("ordered_at"), entity="customer"),
        Dimension(id="customer.region_at_order", version=2, name="Region", aliases=("territory",), column=h("region_name"), edge="commerce.orders_customers_asof@2"),
        Dimension(id="commerce.status", name="Status", column=o("order_status")),
        Rule(id="security.tenant_scope", rule_class="security_obligation", activation=("any_scan_with_tag", "tenant_scoped"), effect=("require_tenant_scope", None)),
        Rule(id="global.exclude_internal_customers", version=2, rule_class="mandatory_business_population", activation=("population_contains_entity", "customer"), edge="commerce.orders_customers_asof@2", required_tables=(HISTORY,),
             effect=("require_population_filter", Bool("and", (Compare("eq", Col(h("is_internal")), Lit(False, "boolean")), Compare("eq", Col(h("is_test_customer")), Lit(False, "boolean")))))),
        Rule(id="commerce.item_revenue_guard", rule_class="semantic_requirement", activation=("uses_table", ITEMS), effect=("require_semijoin_or_allocation", None)),
        Rule(id="global.default_timezone", rule_class="default", activation=("slot_unset", "timezone"), effect=("set_slot", ("timezone", "UTC"))),
        Term(id="glossary.turnover", term="turnover", synonyms=("income",), refs=("finance.revenue@7",)),
    ]
    return Catalog(snapshot_id, records)


def geography() -> Catalog:
    """Orders, their customers, and the customers' nations and regions, several joins apart."""
    orders, customers, nations, regions = (f"star.{n}" for n in ("orders", "customer", "nation", "region"))
    edge = lambda id, left, right, on, **how: Edge(id=f"star.{id}", left=left, right=right, predicates=(("eq", *on),), **how)
    records = [
        *[Table(id=t, physical=t, grain=(key,), certified=True, tags=("fact",) if t == orders else ()) for t, key in ((orders, f"{orders}.o_orderkey"), (customers, f"{customers}.c_custkey"), (nations, f"{nations}.n_nationkey"), (regions, f"{regions}.r_regionkey"))],
        *_columns(orders, "o_orderkey BIGINT", "o_custkey BIGINT", "o_orderdate DATE event", "o_totalprice DOUBLE"),
        *_columns(customers, "c_custkey BIGINT", "c_nationkey BIGINT", "c_mktsegment VARCHAR"),
        *_columns(nations, "n_nationkey BIGINT", "n_regionkey BIGINT", "n_name VARCHAR"),
        *_columns(regions, "r_regionkey BIGINT", "r_name VARCHAR"),
        edge("order_customer", orders, customers, (f"{orders}.o_custkey", f"{customers}.c_custkey"), cardinality="many_to_one"),
        edge("customer_nation", customers, nations, (f"{customers}.c_nationkey", f"{nations}.n_nationkey"), cardinality="many_to_one", join_type="left"),
        # Stated from the region's side, so it is walked in reverse.
        edge("region_nations", regions, nations, (f"{regions}.r_regionkey", f"{nations}.n_regionkey"), cardinality="one_to_many"),
        *[Metric(id=f"star.{n}", name=n, base_table=orders, expression=Aggregate("count"), time_column=f"{orders}.o_orderdate") for n in ("orders_placed", "orders_of_large_nations", "orders_of_other_nations")],
        Metric(id="star.largest", name="largest", base_table=orders, expression=Aggregate("max", Col(f"{orders}.o_totalprice")), time_column=f"{orders}.o_orderdate"),
        Dimension(id="star.r_name", name="Region", column=f"{regions}.r_name"),
        Dimension(id="star.n_name", name="Nation", column=f"{nations}.n_name"),
        Dimension(id="star.segment", name="Segment", column=f"{customers}.c_mktsegment"),
        # Conditions after aggregation: on the measure, and on a key of the groups.
        Rule(id="star.large_only", rule_class="mandatory_business_population", activation=("uses_metric", "star.orders_of_large_nations"), placement="after_aggregation", effect=("require_population_filter", Compare("gte", Col("star.orders_of_large_nations"), Lit(600, "integer")))),
        Rule(id="star.not_seven", rule_class="mandatory_business_population", activation=("uses_metric", "star.orders_of_other_nations"), placement="after_aggregation", effect=("require_population_filter", Compare("ne", Col(f"{nations}.n_name"), Lit("NATION_7")))),
    ]
    return Catalog("demo-1", records)


def geographer() -> Policy:
    """One principal who may see all of the geography."""
    return Policy(1, {"geographer": Principal("geographer", "all", grants={a: ("star.*",) for a in ("discover", "read", "use_in_predicate", "execute_metric", "disclose")})})


def policy(*tenants: str) -> Policy:
    """A full and a restricted principal for the first tenant, and a full one for each other."""
    everything = {a: ("warehouse.commerce.*", "finance.*", "commerce.*", "customer.*") for a in ("discover", "read", "use_in_predicate", "execute_metric", "disclose")}
    made = [Principal(f"full_{t}", t, grants=everything) for t in tenants]
    made.append(Principal("restricted", tenants[0], grants=everything | {"execute_metric": ("commerce.order_count",)}, denies={"read": (f"{ORDERS}.order_amount_usd",), "discover": ("finance.*",)}))
    return Policy(1, {p.id: p for p in made})


def _tenant(key: str) -> SparkColumn:
    return F.when(F.col(key) % 3 == 0, "tenant-a").when(F.col(key) % 3 == 1, "tenant-b").otherwise("tenant-c")


def star_schema(spark: SparkSession, folder: str, *, moved: str = "1998-01-01", until: str = "1998-01-01") -> Resolver:
    """The demo tables derived from the star schema; each customer's region moves once, at ``moved``."""

    def resolve(table_id: str) -> DataFrame:
        if table_id == ORDERS:
            status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled")
            refund = F.when(F.col("o_orderpriority") == "1-URGENT", "fully_refunded").when(F.col("o_orderpriority") == "2-HIGH", "partially_refunded").otherwise("none")
            return table(spark, folder, "orders").select(
                _tenant("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("ordered_at"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("order_amount_usd"), status.alias("order_status"), (F.col("o_orderkey") % 13 == 0).alias("is_test"), refund.alias("refund_status"),
            )
        if table_id == HISTORY:
            nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
            homes = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            flags = [_tenant("c_custkey").alias("tenant_id"), F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 10 == 0).alias("is_internal"), (F.col("c_custkey") % 17 == 0).alias("is_test_customer")]
            at = lambda t: F.lit(t).cast("timestamp")
            first = homes.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*flags, at("1990-01-01").alias("valid_from"), at(until).alias("valid_to"), F.col("r_name").alias("region_name"))
            then = homes.join(region, (F.col("n_regionkey") + 1) % 5 == F.col("r_regionkey")).select(*flags, at(moved).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("r_name").alias("region_name"))
            return first.unionByName(then)
        return table(spark, folder, "lineitem").join(table(spark, folder, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            _tenant("o_custkey").alias("tenant_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("line_amount_usd")
        )

    return resolve
