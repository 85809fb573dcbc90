"""Queries of the general data problems, over their whole tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplan.functions.keys import digest_text, folded
from lodeplan.functions.periods import utc_month
from lodeplan.operators.asof import known_as_of, usable
from lodeplan.operators.history import build_ledger, history
from lodeplan.operators.intervals import interval_runs
from lodeplan.operators.nested import array_items, flatten_json
from lodeplan.operators.orphans import OrphanTracker, current_references, key_index
from lodeplan.operators.snapshots import diff_snapshots, snapshot_order
from lodeplan.sources.tables import cut, table

HOUR_US = 3_600_000_000
OF_ORDERS, OF_ITEMS, OF_COLUMNS, OF_METRICS = "commerce_orders.customer_id", "commerce_order_items.order_id", "catalog_columns.table_id", "catalog_metrics.dependency_refs"
SINGLES, EMBEDDED = ["predicates", "args", "members"], ["predicate"]
NESTED = {"rule": ("catalog_rules", ["activation", "effect"]), "metric": ("catalog_metrics", ["expression", "population"]), "relationship": ("catalog_relationships", ["predicates"])}


def _flat(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    parts = [
        flatten_json(table(spark, folder, name), record_id="record_id", fields=fields, singles=SINGLES, embedded=EMBEDDED, kinds=kinds).withColumn("object_type", F.lit(kind))
        for kind, (name, fields) in NESTED.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON object of the catalog's nested fields, by path."""
    return _flat(spark, folder, ("object",)).select("object_type", "record_id", "node_path")


def p1_array_items(spark: SparkSession, folder: str) -> DataFrame:
    """The objects in predicates, args and members, linked to the object that owns the array."""
    items = array_items(_flat(spark, folder, ("object",)), SINGLES)
    return items.select("object_type", "record_id", "owner_path", "array_key", "position", "node_path")


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """The table of attributes: strings and scalars with their owner's path."""
    return _flat(spark, folder, ("string", "scalar")).select("object_type", "record_id", "parent_path", "key", "slot", "kind", "value")


def p1_column_references(spark: SparkSession, folder: str) -> DataFrame:
    """How often each column is named in nested expressions, by kind of record."""
    values = _flat(spark, folder, ("string",)).filter(F.col("key").isin("column_ref", "left_column", "right_column"))
    column = F.lower(F.trim("value"))
    return values.groupBy("object_type", column.alias("column_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_records"))


def _counted(report: DataFrame, as_of: int | None, field: Column) -> DataFrame:
    """(as_of_us, ref_field, period, reason, n) of a state, stored: the next batches take its place."""
    return cut(report.groupBy(F.lit(as_of).cast("long").alias("as_of_us"), field.alias("ref_field"), utc_month(F.col("at")).alias("period"), "reason").agg(F.count(F.lit(1)).alias("n")))


def _commerce_states(spark: SparkSession, folder: str, increments: int, counted: bool = False) -> tuple[OrphanTracker, OrphanTracker, list[DataFrame]]:
    """The orphan states of orders and order lines after ``increments`` batches by time of ingestion, and
    if asked for the counts after each batch."""
    orders = table(spark, folder, "commerce_orders", "row_id", "tenant_id", "order_id", "customer_id", "op", "ingested_at")
    items = table(spark, folder, "commerce_order_items", "tenant_id", "order_id", "line_number", F.col("ingested_at").alias("at"))
    customers = table(spark, folder, "commerce_customer_history", "tenant_id", "customer_id", "version_id", "recorded_at")
    low, high = orders.agg(F.unix_micros(F.min("ingested_at")), F.unix_micros(F.max("ingested_at"))).first()
    cuts = [low + (high - low) * i // increments for i in range(1, increments)] if low is not None else []
    cuts = [c - c % HOUR_US for c in cuts]

    def batch(df: DataFrame, at: str, i: int) -> DataFrame:
        """Rows of batch i; those without a time belong to the first."""
        if i > 0:
            df = df.filter(F.col(at) >= F.timestamp_micros(F.lit(cuts[i - 1])))
        if i == len(cuts):
            return df
        within = F.col(at) < F.timestamp_micros(F.lit(cuts[i]))
        return df.filter(within | F.col(at).isNull() if i == 0 else within)

    order = ["tenant_id", "order_id"]
    lines = OrphanTracker(order, [*order, "line_number"])
    owners = OrphanTracker(["tenant_id", "customer_id"], order, settles=False)  # histories of customers only grow
    states = []
    for i in range(len(cuts) + 1):
        last = i == len(cuts)
        arrived = key_index(batch(orders, "ingested_at", i), key=order, at="ingested_at", row="row_id", gone=F.col("op") == "delete", carry=["customer_id"])
        lines = lines.advance(batch(items, "at", i), arrived, last=last)
        # An order's customer is stated by its current row: orders delivered in this batch state theirs anew.
        current = lines.index(spark)
        delivered = lines.delivered(spark)
        if i > 0:
            current = current.join(delivered, order, "left_semi")
        recorded = key_index(batch(customers, "recorded_at", i), key=["tenant_id", "customer_id"], at="recorded_at", row="version_id")
        owners = owners.advance(current_references(current, child=order, carry="customer_id", key="customer_id"), recorded, withdrawn=delivered, last=last)
        if counted:
            states += [_counted(t.report(), high if last else cuts[i], F.lit(f)) for f, t in ((OF_ORDERS, owners), (OF_ITEMS, lines))]
    return owners, lines, states


def _catalog_states(spark: SparkSession, folder: str, counted: bool = False) -> tuple[OrphanTracker, DataFrame, list[DataFrame]]:
    """The orphan state of the catalog after all approved snapshots, which are its batches; their order;
    and if asked for the counts after each."""
    order = snapshot_order(table(spark, folder, "catalog_snapshots"))
    clean = lambda c: F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
    tables, columns, metrics, edges = (
        table(spark, folder, f"catalog_{name}", "snapshot_id", "id", *more)
        for name, more in (("tables", ["version"]), ("columns", ["table_id"]), ("metrics", ["version", "dependency_refs"]), ("relationships", ["version"]))
    )
    pinned = F.concat("id", F.lit("@"), F.col("version").cast("string"))
    field = lambda name: F.lit(name).alias("ref_field")
    children = F.concat_ws("|", "snapshot_id", pinned).alias("child_key")
    of_columns = columns.select("snapshot_id", field(OF_COLUMNS), F.concat_ws("|", "snapshot_id", "id").alias("child_key"), clean("table_id").alias("ref_key"))
    of_metrics = metrics.select("snapshot_id", field(OF_METRICS), children, F.explode("dependency_refs").alias("ref")).select("snapshot_id", "ref_field", "child_key", clean("ref").alias("ref_key"))
    held = [tables.select("snapshot_id", field(OF_COLUMNS), F.col("id").alias("ref_key"))] + [df.select("snapshot_id", field(OF_METRICS), pinned.alias("ref_key")) for df in (tables, edges, metrics)]
    known = reduce(DataFrame.unionByName, held)
    references = of_columns.unionByName(of_metrics)
    state = OrphanTracker(["ref_field", "ref_key"], ["ref_field", "child_key"], pinned=True, settles=False)
    states = []
    # The list of snapshots is short by nature, one row per publication.
    for name, at, ord in order.select("snapshot_id", F.unix_micros("published_at"), "ord").orderBy("ord").collect():
        mine = lambda df: df.filter(F.col("snapshot_id") == name).withColumn("at", F.lit(ord))  # noqa: B023, E731
        state = state.advance(mine(references), key_index(mine(known), key=["ref_field", "ref_key"], at="at", row="at"), now=ord)
        if counted:
            states.append(_counted(_dated(state, order), at, F.col("ref_field")))
    return state, order, states


def _both_states(spark: SparkSession, folder: str, increments: int, counted: bool = False) -> tuple[tuple, tuple]:
    """The states of commerce and catalog, whose jobs don't wait for one another."""
    with ThreadPoolExecutor(2) as pool:
        commerce, catalog = pool.submit(_commerce_states, spark, folder, increments, counted), pool.submit(_catalog_states, spark, folder, counted)
        return commerce.result(), catalog.result()


def _dated(state: OrphanTracker, order: DataFrame) -> DataFrame:
    """The report of a catalog state with the time of each reference's snapshot."""
    return state.report().withColumnRenamed("at", "ord").join(order.select("ord", F.col("published_at").alias("at")), "ord")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references of commerce and catalog, by field and month."""
    (owners, lines, _), (catalog, order, _) = _both_states(spark, folder, increments=2)
    month = utc_month(F.col("at")).alias("period")
    text = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    of_orders = owners.report().select(F.lit(OF_ORDERS).alias("ref_field"), text("tenant_id", "order_id").alias("child_key"), text("customer_id").alias("ref_key"), "reason", month)
    of_items = lines.report().select(F.lit(OF_ITEMS).alias("ref_field"), text("tenant_id", "order_id", "line_number").alias("child_key"), text("order_id").alias("ref_key"), "reason", month)
    found = of_orders.unionByName(of_items)
    return found if catalog.batch < 0 else found.unionByName(_dated(catalog, order).select("ref_field", "child_key", "ref_key", "reason", month))


def p2_counts_by_field(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references as counted after each batch, by field and month: four batches of commerce
    by time of ingestion, and every approved snapshot of the catalog."""
    (_, _, commerce), (_, _, catalog) = _both_states(spark, folder, increments=4, counted=True)
    return reduce(DataFrame.unionByName, [*commerce, *catalog])


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pending order lines as counted after each of four batches: resolved and reopened over time."""
    _, _, commerce = _commerce_states(spark, folder, increments=4, counted=True)
    return reduce(DataFrame.unionByName, commerce).filter(F.col("ref_field") == OF_ITEMS).drop("ref_field")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    order = snapshot_order(table(spark, folder, "catalog_snapshots"))
    columns = ["snapshot_id", "id", "version", "source_hash", "loaded_at", "record_id"]
    rows = table(spark, folder, "catalog_tables", *columns).withColumn("object_type", F.lit("table"))
    rows = rows.unionByName(table(spark, folder, "catalog_columns", *columns).withColumn("object_type", F.lit("column")))
    return diff_snapshots(rows, order, keys=["object_type", "id"], compare=[F.col("version"), digest_text(F.col("source_hash"))], latest=["loaded_at", "record_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tables and columns added, removed or changed in each approved snapshot."""
    return _changes(spark, folder).select("object_type", "snapshot_id", "id", "change")


def p3_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many objects changed in which way, per snapshot."""
    return _changes(spark, folder).groupBy("object_type", "snapshot_id", "change").agg(F.count(F.lit(1)).alias("n"))


def _current_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "commerce_orders", "row_id", "tenant_id", "order_id", "customer_id", "ordered_at", "op", "ingested_at")
    index = key_index(orders, key=["tenant_id", "order_id"], at="ingested_at", row="row_id", gone=F.col("op") == "delete", carry=["customer_id", "ordered_at"])
    return index.filter(~F.col("last.gone")).select("tenant_id", "order_id", "last.customer_id", "last.ordered_at").dropna()


def _order_versions(spark: SparkSession, folder: str, versions: DataFrame, carry: list[str]) -> DataFrame:
    raw = table(spark, folder, "commerce_orders", "tenant_id", "customer_id")
    return known_as_of(
        _current_orders(spark, folder), versions, entity=["tenant_id", "customer_id"], event_id=["tenant_id", "order_id"], valid_at="ordered_at", known_at="ordered_at",
        valid_from="valid_from", valid_to="valid_to", recorded_at="recorded_at", version_id="version_id", carry=carry,
        weights=raw.dropna().groupBy("tenant_id", "customer_id").agg(F.count(F.lit(1)).alias("n")), expected_rows=raw.count(),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose customer's region, as known then, isn't the region stated last."""
    versions = usable(table(spark, folder, "commerce_customer_history", "version_id", "tenant_id", "customer_id", "valid_from", "valid_to", "region_name", "recorded_at"))
    last = versions.groupBy("tenant_id", "customer_id").agg(F.max(F.struct("valid_from", "recorded_at", "version_id", folded(F.col("region_name")).alias("region"))).alias("last"))
    marked = versions.join(last, ["tenant_id", "customer_id"]).withColumn("differs", ~folded(F.col("region_name")).eqNullSafe(F.col("last.region"))).drop("last")
    return _order_versions(spark, folder, marked, ["version_id", "differs"]).filter("differs").select("tenant_id", "order_id", "version_id")


def p4_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per tenant and region as known at the time of the order."""
    versions = table(spark, folder, "commerce_customer_history", "version_id", "tenant_id", "customer_id", "valid_from", "valid_to", "region_name", "recorded_at")
    found = _order_versions(spark, folder, versions, ["region_name"])
    return found.groupBy("tenant_id", folded(F.col("region_name")).alias("region")).agg(F.count(F.lit(1)).alias("n_orders"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "commerce_customer_history", "tenant_id", "customer_id", "valid_from", "valid_to")
    return interval_runs(rows, entity=["tenant_id", "customer_id"], start="valid_from", end="valid_to")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps and overlaps of each customer's intervals."""
    return _runs(spark, folder).filter("kind in ('gap', 'overlap')").select("kind", "tenant_id", "customer_id", "from_us", "to_us")


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of each customer."""
    return _runs(spark, folder).filter("kind = 'period'").select("tenant_id", "customer_id", "from_us", "to_us")


CUSTOMER, ATTRIBUTES = ["tenant_id", "customer_id"], ["region_name", "is_internal", "is_test_customer"]


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    updates = table(spark, folder, "customer_updates")
    made = build_ledger(updates, entity=CUSTOMER, at="changed_at", received="received_at", row="update_id", is_delete=F.col("op") == "delete", attributes=ATTRIBUTES)
    return cut(made)  # a ledger is a stored table that is read in several ways


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The versions of each customer that follow from all updates."""
    versions = history(_ledger(spark, folder), entity=CUSTOMER, attributes=ATTRIBUTES, fold=["region_name"])
    return versions.select("tenant_id", "customer_id", "from_us", F.coalesce("to_us", F.lit(-1)).alias("to_us"))


def p6_believed(spark: SparkSession, folder: str) -> DataFrame:
    """The versions as they were believed at the start of 2025, before later updates came in."""
    then = int(datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
    versions = history(_ledger(spark, folder), entity=CUSTOMER, attributes=ATTRIBUTES, fold=["region_name"], as_of_us=then)
    return versions.select("tenant_id", "customer_id", "from_us", F.coalesce("to_us", F.lit(-1)).alias("to_us"))


def p6_superseded(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows and how many of them later updates superseded, per tenant."""
    ledger = _ledger(spark, folder)
    return ledger.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("recorded_to_us").alias("n_superseded"), F.count_distinct("customer_id").alias("n_customers"))


QUERIES = {f.__name__: f for f in (p1_found, p1_array_items, p1_values, p1_column_references, p2_found, p2_counts, p2_counts_by_field, p3_found, p3_summary, p4_found, p4_regions, p5_found, p5_periods, p6_found, p6_believed, p6_superseded)}
