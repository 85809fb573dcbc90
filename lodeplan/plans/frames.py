"""Bound plans as DataFrames: the answer itself, and the proof that its joins don't multiply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplan.functions.expressions import Context, columns_in
from lodeplan.functions.periods import bucket
from lodeplan.plans.binding import Bound
from lodeplan.plans.catalog import Catalog, table_of
from lodeplan.plans.errors import Reason, Refused

#: Gives the DataFrame of a table id; whatever rows it holds is what a request can see.
Resolver = Callable[[str], DataFrame]


def within_tenant(resolver: Resolver, catalog: Catalog, tenant: str) -> Resolver:
    """A resolver that shows one tenant's rows only, whatever is built on it: a boundary of its
    own beside the tenant conditions that every plan carries."""

    def resolve(table_id: str) -> DataFrame:
        key = catalog.get("table", table_id).tenant_key
        df = resolver(table_id)
        return df.filter(F.col(catalog.get("column", key).name) == F.lit(tenant)) if key else df

    return resolve


def preflight(df: DataFrame) -> str:
    """The physical plan; planning reads footers and statistics but runs nothing."""
    return df._jdf.queryExecution().executedPlan().toString()


def context(bound: Bound) -> Context:
    alias = {t: f"t{i}" for i, t in enumerate(bound.tables)}

    def column(id: str) -> Column:
        if table_of(id) not in alias:
            raise Refused(Reason.UNRESOLVED_REFERENCE, f"{id} isn't scanned")
        return F.col(f"{alias[table_of(id)]}.`{bound.catalog.get('column', id).name}`")

    return Context(column, bound.catalog.value_sets, bound.params)


def join_condition(ctx: Context, predicates: tuple[tuple[str, str, str], ...]) -> Column:
    """The predicates of an edge; ``lt_or_null`` takes a null bound as open."""
    parts = []
    for op, left, right in predicates:
        a, b = ctx.column(left), ctx.column(right)
        parts.append({"eq": a == b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b, "lt_or_null": (a < b) | b.isNull()}[op])
    return reduce(lambda x, y: x & y, parts)


def scan(bound: Bound, resolver: Resolver, table: str, ctx: Context, conditions: list) -> DataFrame:
    """A table's rows under the conditions that concern it alone, narrowed to the columns in use.

    Filtering each scan before it is joined keeps tenant and time conditions next to the files,
    where they prune partitions and row groups.
    """
    i = bound.tables.index(table)
    df = resolver(table).alias(f"t{i}")
    for predicate in conditions:
        df = df.filter(ctx.predicate(predicate))
    return df.select(*[ctx.column(c) for c in sorted(bound.columns.get(table, ()))])


def joined(bound: Bound, resolver: Resolver, ctx: Context, *, origins: Callable[[str], bool] = lambda origin: True) -> DataFrame:
    """Base table and joins, filtered; conditions on a left-joined table come after its join."""
    optional = {s.there for s in bound.steps if s.edge.join_type == "left"}
    own: dict[str, list] = {t: [] for t in bound.tables}
    after = []
    for origin, predicate in bound.where:
        tables = {table_of(c) for c in columns_in(predicate)}
        if not origins(origin):
            continue
        if len(tables) == 1 and not (tables & optional and origin != "tenant"):
            own[tables.pop()].append(predicate)
        else:
            after.append(predicate)
    df = scan(bound, resolver, bound.tables[0], ctx, own[bound.tables[0]])
    for step in bound.steps:
        df = df.join(scan(bound, resolver, step.there, ctx, own[step.there]), join_condition(ctx, step.edge.predicates), step.edge.join_type)
    for predicate in after:
        df = df.filter(ctx.predicate(predicate))
    return df


def build(bound: Bound, resolver: Resolver) -> DataFrame:
    """The metric by bucket and dimensions, without order and limit."""
    ctx = context(bound)
    df = joined(bound, resolver, ctx)
    keys = [ctx.column(column).alias(alias) for alias, column in bound.dimensions]
    if bound.request.grain:
        keys.insert(0, bucket(ctx.column(bound.metric.time_column), bound.request.grain, bound.timezone).alias(bound.request.grain))
    measure = ctx.measure(bound.metric.expression).alias(bound.measure)
    out = df.groupBy(*keys).agg(measure)
    for _, predicate in bound.having:
        out = out.filter(Context(lambda id: F.col(bound.measure if id == bound.metric.id else id.rpartition(".")[2]), ctx.value_sets, ctx.params).predicate(predicate))
    return out


def combine(parts: list[tuple[Bound, DataFrame]]) -> DataFrame:
    """Several metrics on one grid: each is aggregated on its own, then they are joined in full.

    Facts are never joined row by row, so none multiplies another; the join is on the small
    aggregated results, with nulls in keys matching each other.
    """
    (first, out), *others = parts
    keys = first.keys
    for bound, df in others:
        if bound.keys != keys:
            raise Refused(Reason.VALIDATION_FAILED, "metrics of a request share their dimensions")
        if not keys:
            out = out.join(df, F.lit(True), "full_outer")
            continue
        right = df.select(*[F.col(k).alias(f"_{k}") for k in keys], bound.measure)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        joined = out.join(right, on, "full_outer")
        out = joined.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[c for c in joined.columns if c not in keys and not (c.startswith("_") and c[1:] in keys)])
    return out


def ordered(df: DataFrame, keys: list[str], order_by: tuple[tuple[str, str], ...], limit: int | None) -> DataFrame:
    """Ordered by the given columns, then by all keys so that a limit is deterministic; nulls last.
    Only a limit that was asked for cuts."""
    named = [*order_by, *[(k, "asc") for k in keys if k not in dict(order_by)]]
    columns = [F.asc_nulls_last(n) if d == "asc" else F.desc_nulls_last(n) for n, d in named]
    df = df.orderBy(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def attestations(bound: Bound, resolver: Resolver) -> list[tuple[str, DataFrame]]:
    """For each join that needs proof a one-row frame (facts, overlapping, unmatched).

    Counted before any condition on the joined side, over the facts that the request reads: tenant
    and time conditions of the base table apply, those on the dimension don't hide a double match.
    """
    ctx, out = context(bound), []
    for n, step in enumerate(bound.steps):
        if not step.edge.attested:
            continue
        base = bound.tables[0]
        about = lambda predicate: {table_of(c) for c in columns_in(predicate)}
        left = replace(bound, columns={t: set(c) for t, c in bound.columns.items()})
        grain = bound.catalog.get("table", base).grain
        for column in grain:
            left.columns.setdefault(base, set()).add(column)
        # An equality that matched has a non-null right side, so its column tells matches apart.
        probe = next((right for op, _, right in step.edge.predicates if op == "eq"), None)
        if probe is None:
            raise Refused(Reason.FAN_OUT_UNPROVEN, f"{step.edge.ref} has no key to probe")
        df = scan(left, resolver, base, ctx, [p for _, p in bound.where if about(p) == {base}])
        for earlier in bound.steps[: n + 1]:
            conditions = [p for o, p in bound.where if o == "tenant" and about(p) == {earlier.there}]
            df = df.join(scan(left, resolver, earlier.there, ctx, conditions), join_condition(ctx, earlier.edge.predicates), "left")
        per_fact = df.groupBy(*[ctx.column(c).alias(f"g{i}") for i, c in enumerate(grain)]).agg(F.count(ctx.column(probe)).alias("n"))
        out.append((step.edge.ref, per_fact.agg(F.count(F.lit(1)).alias("facts"), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("overlapping"), F.coalesce(F.sum((F.col("n") == 0).cast("int")), F.lit(0)).alias("unmatched"))))
    return out
