"""Time slices of entities that have too many rows for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(rows: DataFrame, hot: DataFrame, keys: list[str], at: str, *, most: int, slice_rows: int) -> DataFrame:
    """``keys`` and ``cuts``: sorted cut points that divide each hot entity's rows into slices.

    ``hot`` has the entities and their numbers of rows ``n``, of which ``most`` is the greatest. The
    points are approximate quantiles of ``at`` (a long), one per ``slice_rows`` rows, so slices hold
    about equal numbers of rows however unevenly they lie in time. Nulls in ``at`` don't count.
    The quantiles are aggregated before they are shuffled.
    """
    finest = max(1, -(-most // slice_rows))
    points = F.percentile_approx(at, [i / finest for i in range(1, finest)] or [0.5], F.lit(max(10_000, 20 * finest)))
    found = rows.join(hot.select(*keys), keys, "left_semi").groupBy(*keys).agg(points.alias("points")).join(hot, keys)
    step = F.greatest(F.lit(1), F.expr(f"{finest} div greatest(1, ceil(n / {slice_rows}))"))
    own = F.filter("points", lambda _, i: (i + 1) % step == 0) if finest > 1 else F.array().cast("array<bigint>")
    return found.select(*keys, F.array_sort(F.array_distinct(own)).alias("cuts"))


def slice_of(at: Column, cuts: Column, finest: int) -> Column:
    """How many of the sorted ``cuts``, at most ``finest``, an instant has reached; found by halving."""
    steps = [1 << b for b in reversed(range(max(1, finest).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda reached, s: F.when(F.get(cuts, reached + s - 1) <= at, reached + s).otherwise(reached))
