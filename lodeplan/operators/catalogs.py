"""Catalog work over whole catalog tables: closures, publication checks, search cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplan.functions.text import short_id
from lodeplan.sources.tables import cut

PINNED = ["snapshot_id", "id", "version"]


def latest(records: DataFrame, *columns: str) -> DataFrame:
    """One row per snapshot and id: the last delivery by (loaded_at, record_id), with ``columns`` or all.

    Only the columns asked for are shuffled.
    """
    rest = list(columns) or [c for c in records.columns if c not in ("snapshot_id", "id")]
    return records.groupBy("snapshot_id", "id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "record_id")).alias("r")).select("snapshot_id", "id", *[F.col(f"r.{c}").alias(c) for c in rest])


def queryable(tables: DataFrame) -> DataFrame:
    """Tables that may be executed: approved and certified, with a key."""
    return latest(tables, "publication_status", "is_certified", "primary_key", "domain").filter((F.lower("publication_status") == "approved") & F.col("is_certified") & (F.size("primary_key") > 0)).select("snapshot_id", "id", "domain")


def metric_closure(values: DataFrame, metrics: DataFrame) -> DataFrame:
    """(snapshot_id, id, version, column_id, table_id, part): every column a metric stands on.

    ``values``: the attribute table of the metrics' nested expressions, with record_id, field and
    value. One join on the record, so all metrics are closed over at once.
    """
    named = values.filter(F.col("key") == "column_ref").select("record_id", "field", F.lower(F.trim("value")).alias("column_id"))
    part = F.when(F.col("field") == "expression", "measure").otherwise("population").alias("part")
    table_id = F.regexp_replace("column_id", r"\.[^.]*$", "")
    return named.join(metrics.select("record_id", *PINNED), "record_id").select(*PINNED, "column_id", table_id.alias("table_id"), part).distinct()


def activated_rules(closure: DataFrame, rule_values: DataFrame, rules: DataFrame) -> DataFrame:
    """(snapshot_id, metric_id, rule_id): rules that a metric's columns or their tables activate.

    Only the ops uses_column and uses_table, and only tables of named columns; all that the
    tables can decide is in :func:`decidable_rules`.
    """
    parts = rule_values.filter("field = 'activation' and parent_path = 'activation'").groupBy("record_id").agg(F.max(F.when(F.col("key") == "op", F.lower("value"))).alias("op"), F.max(F.when(F.col("key") == "object_id", F.lower("value"))).alias("object_id"))
    active = parts.filter("op in ('uses_column', 'uses_table') and object_id is not null").join(rules.select("record_id", "snapshot_id", F.col("id").alias("rule_id")), "record_id").select("snapshot_id", "rule_id", "op", "object_id").distinct()
    uses = closure.select("snapshot_id", F.col("id").alias("metric_id"), F.lit("uses_column").alias("op"), F.col("column_id").alias("object_id")).unionByName(closure.select("snapshot_id", F.col("id").alias("metric_id"), F.lit("uses_table").alias("op"), F.col("table_id").alias("object_id"))).distinct()
    return uses.join(active, ["snapshot_id", "op", "object_id"]).select("snapshot_id", "metric_id", "rule_id").distinct()


def metric_tables(closure: DataFrame, metrics: DataFrame) -> DataFrame:
    """(snapshot_id, id, version, table_id): the tables of a metric's columns and its base table."""
    base = metrics.select(*PINNED, F.lower(F.trim("base_table")).alias("table_id")).dropna(subset=["table_id"])
    return closure.select(*PINNED, "table_id").unionByName(base).distinct()


def decidable_rules(closure: DataFrame, rule_values: DataFrame, rules: DataFrame, metrics: DataFrame, tables: DataFrame) -> DataFrame:
    """(snapshot_id, metric_id, rule_id): every rule that a metric activates by what the catalog's tables say.

    Decided, each by an equality join within the snapshot: uses_column; uses_table and
    any_scan_with_tag, over the metric's tables with its base table (tags as last delivered);
    uses_metric, by id or id@version. An activation that names no object activates nothing. The
    tables can't decide population_contains_entity (metrics state no entity there) and slot_unset
    (a matter of the request); ``always`` holds for every metric and isn't listed. These are
    activations by the metric itself, before rules bring in tables of their own.
    """
    named = lambda key: F.max(F.when(F.col("key") == key, F.lower(F.trim("value")))).alias(key)
    parts = rule_values.filter("field = 'activation' and parent_path = 'activation'").groupBy("record_id").agg(*map(named, ("op", "object_id", "tag", "metric_ref")))
    object_id = F.when(F.col("op").isin("uses_column", "uses_table"), F.col("object_id")).when(F.col("op") == "any_scan_with_tag", F.col("tag")).when(F.col("op") == "uses_metric", F.col("metric_ref"))
    active = parts.withColumn("object_id", object_id).dropna(subset=["object_id"]).join(rules.select("record_id", "snapshot_id", F.col("id").alias("rule_id")), "record_id").select("snapshot_id", "rule_id", "op", "object_id").distinct()

    def uses(op: str, df: DataFrame, object_id: Column) -> DataFrame:
        return df.select("snapshot_id", F.col("id").alias("metric_id"), F.lit(op).alias("op"), object_id.alias("object_id"))

    reached = metric_tables(closure, metrics)
    tags = latest(tables).select("snapshot_id", F.lower(F.trim("id")).alias("table_id"), F.explode("tags").alias("tag"))
    fold = lambda c: F.lower(F.trim(c))
    every = [
        uses("uses_column", closure, F.col("column_id")),
        uses("uses_table", reached, F.col("table_id")),
        uses("any_scan_with_tag", reached.join(tags, ["snapshot_id", "table_id"]), fold("tag")),
        uses("uses_metric", metrics, fold("id")),
        uses("uses_metric", metrics, F.concat(fold("id"), F.lit("@"), F.col("version").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, every).distinct().join(active, ["snapshot_id", "op", "object_id"]).select("snapshot_id", "metric_id", "rule_id").distinct()


def unresolved(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check, snapshot_id, id, ref): references a snapshot doesn't hold.

    Each check is (name, references (snapshot_id, id, ref), targets (snapshot_id, ref)).
    """
    parts = [references.dropna(subset=["ref"]).join(targets.distinct(), ["snapshot_id", "ref"], "left_anti").select(F.lit(name).alias("check"), "snapshot_id", "id", "ref").distinct() for name, references, targets in checks]
    return reduce(DataFrame.unionByName, parts)


def mentions(values: DataFrame, owners: dict[str, DataFrame]) -> DataFrame:
    """(check, snapshot_id, id, ref, target) of columns and tables that nested texts name.

    ``values``: the strings of the nested texts (see :func:`lodeplan.operators.nested.flatten_json`) with
    ``object_type``; ``owners``: per object type the records (record_id, snapshot_id, id). Named are
    columns by column_ref in metrics and rules and by left_column and right_column in relationships,
    tables by required_tables in a rule's effect.
    """
    records = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("object_type"), "record_id", "snapshot_id", "id") for kind, df in owners.items()])
    column = ((F.col("object_type") == "relationship") & F.col("key").isin("left_column", "right_column")) | ((F.col("object_type") != "relationship") & (F.col("key") == "column_ref"))
    required = (F.col("object_type") == "rule") & (F.col("parent_path") == "effect.required_tables") & F.col("key").isNull()
    named = values.withColumn("target", F.when(column, "column").when(required, "table")).dropna(subset=["target"])
    check = F.concat("object_type", F.lit("."), F.coalesce("key", F.lit("required_tables")))
    return named.join(records, ["object_type", "record_id"]).select(check.alias("check"), "snapshot_id", "id", F.lower(F.trim("value")).alias("ref"), "target")


def table_mentions(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(check, snapshot_id, id, ref, target): the columns of grains and keys, the tables of columns."""
    keyed = [tables.select(F.lit(f"table.{c}").alias("check"), "snapshot_id", "id", F.explode(c).alias("ref"), F.lit("column").alias("target")) for c in ("grain", "primary_key")]
    owned = columns.select(F.lit("column.table_id").alias("check"), "snapshot_id", "id", F.col("table_id").alias("ref"), F.lit("table").alias("target"))
    return reduce(DataFrame.unionByName, [*keyed, owned]).withColumn("ref", F.lower(F.trim("ref")))


def unresolved_mentions(named: DataFrame, targets: DataFrame) -> DataFrame:
    """(check, snapshot_id, id, ref): what is named but isn't in its snapshot, each once.

    ``named``: (check, snapshot_id, id, ref, target); ``targets``: (target, snapshot_id, ref). All checks
    go through one join. A null or empty reference is none.
    """
    return named.filter(F.col("ref") != "").distinct().join(targets.distinct(), ["target", "snapshot_id", "ref"], "left_anti").select("check", "snapshot_id", "id", "ref")


def dependency_levels(metrics: DataFrame) -> DataFrame:
    """(snapshot_id, ref, level, cyclic): how deep metrics are built from other metrics, for all snapshots at once.

    ``ref`` is id@version; a metric without metric dependencies in its snapshot has level 0, any other
    one more than its highest dependency. Metrics that reach a cycle are cyclic and have no level.
    A round drops the edges to metrics that have none left; the edges that remain are stored, so
    their lineage is one read, and as many rounds run as levels exist. Dependencies on tables, relationships,
    absent metrics and null ones don't count; repeated deliveries give the union of their edges.
    """
    ref = F.lower(F.concat(F.trim("id"), F.lit("@"), F.col("version").cast("string"))).alias("ref")
    nodes = metrics.select("snapshot_id", ref).dropna().distinct()
    edges = metrics.select("snapshot_id", ref, F.explode("dependency_refs").alias("on")).select("snapshot_id", "ref", F.lower(F.trim("on")).alias("on")).dropna().distinct()
    left = cut(edges.join(nodes.withColumnRenamed("ref", "on"), ["snapshot_id", "on"], "left_semi").select("snapshot_id", "ref", "on"))
    rounds, n = [left.select("snapshot_id", "ref")], left.count()
    while n:
        left = cut(left.join(left.select("snapshot_id", F.col("ref").alias("on")).distinct(), ["snapshot_id", "on"], "left_semi").select("snapshot_id", "ref", "on"))
        before, n = n, left.count()
        if n == before:
            break
        rounds.append(left.select("snapshot_id", "ref"))
    # A metric stands in as many rounds as it has levels below it; those of the last edges never left.
    seen = reduce(DataFrame.unionByName, [df.distinct().withColumn("stuck", F.lit(False)) for df in rounds] + [left.select("snapshot_id", "ref").distinct().withColumn("stuck", F.lit(True))])
    levels = seen.groupBy("snapshot_id", "ref").agg(F.sum((~F.col("stuck")).cast("int")).cast("int").alias("level"), F.max("stuck").alias("cyclic"))
    joined = nodes.join(levels, ["snapshot_id", "ref"], "left")
    return joined.select("snapshot_id", "ref", F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).cast("int").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


#: What a physical name may look like, and the comparisons that order two columns.
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
ORDERINGS = ("lt", "lte", "gt", "gte", "lt_or_null")


def invalid_records(tables: DataFrame, columns: DataFrame, relationships: DataFrame, values: DataFrame) -> DataFrame:
    """(check, snapshot_id, record_id): records that contradict themselves.

    column.parent: the table isn't what stands before the last dot of the id, or is null.
    table.identifier: a part of the physical name is null or no plain identifier.
    table.key_of_other_table: grain or key has a column of another table.
    relationship.not_temporal: temporal, but no predicate compares by order. ``values``: as in :func:`mentions`.
    """
    before_dot = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.[^.]*$", "")
    parent = columns.filter(~before_dot(F.col("id")).eqNullSafe(F.lower(F.trim("table_id"))))
    plain = [F.coalesce(F.col(f"physical.{c}").rlike(IDENTIFIER), F.lit(False)) for c in ("database", "schema_name", "name")]
    unsafe = tables.filter(~(plain[0] & plain[1] & plain[2]))
    others = F.exists(F.concat(F.coalesce("grain", F.array()), F.coalesce("primary_key", F.array())), lambda c: before_dot(c) != F.lower(F.trim("id")))
    foreign = tables.filter(others)
    ordered = values.filter((F.col("object_type") == "relationship") & (F.col("key") == "op") & F.lower("value").isin(*ORDERINGS)).select("record_id").distinct()
    timeless = relationships.filter("is_temporal").join(ordered, "record_id", "left_anti")
    found = {"column.parent": parent, "table.identifier": unsafe, "table.key_of_other_table": foreign, "relationship.not_temporal": timeless}
    return reduce(DataFrame.unionByName, [df.select(F.lit(check).alias("check"), "snapshot_id", "record_id") for check, df in found.items()])


def column_cards(columns: DataFrame) -> DataFrame:
    """(snapshot_id, id, object_type, table_id, domain, access_scope, title, content) of columns."""
    rows = latest(columns, "table_id", "domain", "access_scope", "name", "data_type", "synonyms", "unit", "classification")
    content = F.concat_ws(" ", F.lit("column"), "name", "data_type", F.concat_ws(" ", "synonyms"), "unit", "classification")
    return rows.select("snapshot_id", "id", F.lit("column").alias("object_type"), F.lower(F.trim("table_id")).alias("table_id"), "domain", "access_scope", F.col("name").alias("title"), content.alias("content"))


def cards(tables: DataFrame, columns: DataFrame, metrics: DataFrame, relationships: DataFrame) -> DataFrame:
    """(chunk_id, snapshot_id, object_id, object_type, table_id, domain, access_scope, title, content): a search card per object."""
    none = F.lit(None).cast("string")
    open_to_all = none.alias("access_scope")
    words = lambda *c: F.concat_ws(" ", *c)
    parts = [
        latest(tables, "domain", "access_scope", "name", "tags").select("snapshot_id", "id", F.lit("table").alias("object_type"), F.col("id").alias("table_id"), "domain", "access_scope", F.col("name").alias("title"), words(F.lit("table"), "name", "domain", F.concat_ws(" ", "tags")).alias("content")),
        column_cards(columns),
        latest(metrics, "base_table", "domain", "unit").select("snapshot_id", "id", F.lit("metric").alias("object_type"), F.lower(F.trim("base_table")).alias("table_id"), "domain", open_to_all, F.col("id").alias("title"), words(F.lit("metric"), "id", "unit").alias("content")),
        latest(relationships, "domain", "left_table", "right_table", "cardinality").select("snapshot_id", "id", F.lit("relationship").alias("object_type"), none.alias("table_id"), "domain", open_to_all, F.col("id").alias("title"), words(F.lit("relationship"), "left_table", "right_table", "cardinality").alias("content")),
    ]
    return _with_ids(reduce(DataFrame.unionByName, parts))


def more_cards(tables: DataFrame, columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Search cards like those of :func:`cards` for what spans tables: a rule by its class, domain and
    what it does in case of failure; a domain by the names of its tables; a glossary term by the
    columns it is a synonym of. A null or blank domain or term has no card."""
    none = F.lit(None).cast("string")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    word = F.lower(F.trim("term"))
    terms = latest(columns, "synonyms").select("snapshot_id", F.col("id").alias("ref"), F.explode("synonyms").alias("term")).withColumn("term", word).filter("term <> ''")
    domains = latest(tables, "domain", "name").filter(F.trim("domain") != "")
    own = lambda kind, df, domain, title, content: df.select("snapshot_id", "id", F.lit(kind).alias("object_type"), none.alias("table_id"), domain.alias("domain"), none.alias("access_scope"), title.alias("title"), content.alias("content"))
    by_domain = domains.groupBy("snapshot_id", F.col("domain").alias("id")).agg(listed("name").alias("names"))
    by_term = terms.groupBy("snapshot_id", F.col("term").alias("id")).agg(listed("ref").alias("refs"))
    parts = [
        own("rule", latest(rules, "domain", "rule_class", "failure"), F.col("domain"), F.col("id"), F.concat_ws(" ", F.lit("rule"), "id", "rule_class", "failure")),
        own("domain", by_domain, F.col("id"), F.col("id"), F.concat_ws(" ", F.lit("domain"), "id", "names")),
        own("term", by_term, none, F.col("id"), F.concat_ws(" ", F.lit("term"), "id", "refs")),
    ]
    return _with_ids(reduce(DataFrame.unionByName, parts))


def _with_ids(every: DataFrame) -> DataFrame:
    return every.select(short_id(F.col("snapshot_id"), F.col("object_type"), F.col("id")).alias("chunk_id"), "snapshot_id", F.col("id").alias("object_id"), "object_type", "table_id", "domain", "access_scope", "title", "content")
