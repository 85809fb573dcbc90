"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeplan.functions.keys import canonical_hash
from lodeplan.sources.tables import cut


def snapshot_order(snapshots: DataFrame, *, state: str = "approved") -> DataFrame:
    """``(snapshot_id, published_at, ord, is_last)`` of the snapshots in ``state``, ord from 1.

    The list of snapshots is short by nature (one row per publication), so its one-partition
    window is no bottleneck. Equal times are ordered by id.
    """
    w = Window.orderBy("published_at", "snapshot_id")
    return (
        snapshots.filter(F.col("state") == state)
        .select("snapshot_id", "published_at")
        .distinct()
        .withColumn("ord", F.row_number().over(w))
        .withColumn("is_last", F.lead("ord").over(w).isNull())
    )


def diff_snapshots(rows: DataFrame, order: DataFrame, *, keys: list[str], compare: list[Column], latest: list[str], snapshot: str = "snapshot_id") -> DataFrame:
    """Records added, removed or changed in each snapshot against the one before.

    ``rows`` has the primary key ``keys``, the ``snapshot`` column and whatever ``compare`` and
    ``latest`` use; other columns are ignored. ``order`` comes from :func:`snapshot_order`.
    Repeated deliveries of a key in a snapshot count once, the greatest by ``latest``.

    Method: canonical row hashes, then a full outer join of every snapshot with its predecessor
    on the primary key; a missing side is an addition or removal, unequal hashes a change. All
    snapshots go through one join, whose key holds the snapshot's ordinal. The latest row is
    found by a map-side combined aggregate, so repeated deliveries of one key never gather in a
    task; afterwards (key, ordinal) is unique and the join can't be skewed.

    Returns ``keys + [snapshot, change]``. The first snapshot has no predecessor and yields
    nothing. A null key is a key like any other; a null compared value differs from every other
    value. Empty input gives an empty result.
    """
    k = [f"k{i}" for i in range(len(keys))]
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(snapshot).alias("snap"), F.struct(*latest, canonical_hash(*compare).alias("_hash")).alias("row"))
    steps = order.select(F.col(snapshot).alias("snap"), "ord", "is_last")
    # Both sides of the join below read it; stored, it is read, hashed and shuffled once.
    current = cut(narrow.join(steps, "snap").groupBy(*k, "ord", "is_last").agg(F.max("row")["_hash"].alias("hash")))
    later = current.filter("ord > 1").select(*k, "ord", "hash")
    before = current.filter("not is_last").select(*[F.col(n).alias(f"_{n}") for n in k], (F.col("ord") + 1).alias("_ord"), F.col("hash").alias("_hash"))
    on = F.col("ord") == F.col("_ord")
    for n in k:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    change = F.when(F.col("_hash").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("_hash"), "changed")
    changes = (
        later.join(before, on, "full_outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*[F.when(F.col("hash").isNull(), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in k], F.coalesce("ord", "_ord").alias("ord"), "change")
    )
    return changes.join(steps, "ord").select(*[F.col(n).alias(c) for n, c in zip(k, keys)], F.col("snap").alias(snapshot), "change")
