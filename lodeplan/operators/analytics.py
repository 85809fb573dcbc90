"""Larger query shapes composed from Spark's joins, windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_fact(facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Facts that are aggregated to common keys, side by side; nulls in keys match.

    Each fact must be unique on ``keys``. A union and one aggregation do the work of a chain of
    full outer joins with a single shuffle, however many facts there are.
    """
    values = [[c for c in f.columns if c not in keys] for f in facts]
    parts = []
    for i, fact in enumerate(facts):
        others = [F.lit(None).cast(facts[j].schema[c].dataType).alias(c) if j != i else F.col(c) for j, own in enumerate(values) for c in own]
        parts.append(fact.select(*keys, *others))
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(*keys).agg(*[F.max(c).alias(c) for own in values for c in own])


def retention(events: DataFrame, *, user: str, at: str, grain: str = "month", periods: int = 3) -> DataFrame:
    """(cohort, period, size, active, percent): who of a first-period cohort came back when.

    Periods without anyone show 0. One aggregation finds first periods, one counts distinct
    users, both with map-side combine.
    """
    active = events.dropna(subset=[user, at]).select(F.col(user).alias("u"), F.date_trunc(grain, at).alias("p")).distinct()
    first = Window.partitionBy("u")
    placed = active.withColumn("cohort", F.min("p").over(first))
    apart = F.round(F.months_between("p", "cohort")).cast("int") if grain == "month" else F.datediff("p", "cohort")
    counted = placed.withColumn("period", apart).filter(F.col("period") <= periods).groupBy("cohort", "period").agg(F.count(F.lit(1)).alias("active"))
    sizes = counted.filter("period = 0").select("cohort", F.col("active").alias("size"))
    spine = sizes.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods))))
    return spine.join(counted, ["cohort", "period"], "left").select("cohort", "period", "size", F.coalesce("active", F.lit(0)).alias("active"), F.round(100.0 * F.coalesce("active", F.lit(0)) / F.col("size"), 2).alias("percent"))


def ranked(df: DataFrame, *, by: list[str], order: list[Column], n: int, ties: str = "rank") -> DataFrame:
    """The first n per group; ``ties``: ``rank`` and ``dense_rank`` keep equals, ``row_number`` doesn't."""
    number = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}[ties]()
    return df.withColumn("position", number.over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("position") <= n)


def spine(df: DataFrame, *, keys: list[str], bucket: str, step: str, fill: dict[str, object]) -> DataFrame:
    """Missing buckets of each key between its first and last one, with the fill values."""
    span = df.groupBy(*keys).agg(F.min(bucket).alias("a"), F.max(bucket).alias("b"))
    grid = span.select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(bucket))
    return grid.join(df, [*keys, bucket], "left").fillna(fill)


def period_change(df: DataFrame, *, keys: list[str], bucket: str, value: str) -> DataFrame:
    """Each bucket with the one before: absolute and relative change, null where that was 0 or nothing."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(bucket))
    out = df.withColumn("before", before)
    return out.withColumn("change", F.col(value) - F.col("before")).withColumn("percent", F.round(100.0 * F.col("change") / F.when(F.col("before") != 0, F.col("before")), 2))


def funnel(events: DataFrame, *, user: str, at: str, kind: str, steps: list[str]) -> DataFrame:
    """(step, name, users): users who took the steps in order, each at or after the one before.

    A chain of minima: each step keeps one time per user, the first that isn't before the last
    step's, so a user with very many events stays a partial aggregate and is never gathered.
    """
    relevant = events.filter(F.col(kind).isin(*steps)).dropna(subset=[user, at]).select(F.col(user).alias("u"), F.col(at).alias("t"), F.col(kind).alias("k"))
    reached = relevant.filter(F.col("k") == steps[0]).groupBy("u").agg(F.min("t").alias("t0"))
    for i, name in enumerate(steps[1:], 1):
        later = relevant.filter(F.col("k") == name).join(reached.select("u", F.col(f"t{i - 1}").alias("p")), "u").filter("t >= p").groupBy("u").agg(F.min("t").alias(f"t{i}"))
        reached = reached.join(later, "u", "left")
    counts = reached.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(steps))])
    rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("name"), F.col(f"n{i}").alias("users")) for i, s in enumerate(steps)]
    return counts.select(F.inline(F.array(*rows)))


def latest_then_sum(df: DataFrame, *, entity: list[str], keys: list[str], at: list[str], value: str) -> DataFrame:
    """A semi-additive measure: each entity's last value within the keys, summed over entities."""
    last = df.groupBy(*keys, *entity).agg(F.max(F.struct(*at, F.col(value).alias("v"))).alias("last"))
    return last.groupBy(*keys).agg(F.sum("last.v").alias(value), F.count(F.lit(1)).alias("n"))


def allocate(parent: DataFrame, child: DataFrame, *, key: list[str], amount: str, weight: str) -> DataFrame:
    """Child rows with their share of the parent's amount by weight; equal shares if all weigh 0.

    The way to cross a multiplying join with an additive measure: shares of a parent sum up to it.
    """
    # Totals come from an aggregate with map-side combine, so no parent's rows gather in a window.
    totals = child.groupBy(*key).agg(F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_total") != 0, F.col(weight) / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n"))
    return child.join(parent.select(*key, F.col(amount).alias("_amount")).join(totals, key), key).withColumn("allocated", F.col("_amount").cast("double") * share.cast("double")).drop("_total", "_n", "_amount")
