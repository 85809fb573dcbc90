"""Attributes as known at event time: a join of events with bitemporal versions.

Each event is matched with the version valid at its valid time that was recorded last among
those recorded by its known time, never with one recorded later.

Method: per entity a persistent segment tree over valid time. Versions are painted in the order
in which they became known; each copies the nodes on its paths and has a root of its own, so
every earlier state stays readable. An event picks the root of its known time and descends by its
valid time; the highest mark on its path is the version that was recorded last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.operators.arrays import codes, longs, ranks, starts
from lodeplan.operators.slices import cut_points, slice_of
from lodeplan.sources.tables import cut

OPEN = np.iinfo(np.int64).max
#: Events and versions of one task's group; entities with more are split over several groups.
SHARD_ROWS = 50_000


class Forest:
    """Persistent segment trees of many entities, built level by level for all versions at once.

    Version ``v`` of tree ``tree[v]`` paints the leaves [low, high). It copies the nodes on its
    paths, so that each version has a root of its own and every earlier state stays readable; what
    it doesn't touch it shares with the versions before. Versions are sorted by tree, and within it
    by the order in which they are painted. A tree has 2^depth leaves.
    """

    def __init__(self, tree: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        n, levels = len(tree), int(depth.max(initial=0)) + 1
        version, place = np.arange(n), np.zeros(n, np.int64)
        self.left, self.right, self.mark = ([np.zeros(1, np.int64)] for _ in range(3))
        self.mark = [np.full(1, -1)]
        self.depth, count, above = depth, 1, None
        for level in range(levels):
            # Nodes of this level in the order of (tree, place, version); ``key`` finds them.
            offset = np.cumsum(np.where(depth >= level, 1 << level, 0)) - (1 << level)
            order = np.argsort((offset[tree[version]] + place) * n + version)
            version, place = version[order], place[order]
            spot = offset[tree[version]] + place
            key = spot * n + version
            if above is not None:
                self._link(*above, offset, key, n, count)
            shift = depth[tree[version]] - level
            full = (low[version] <= place << shift) & ((place + 1) << shift <= high[version])
            # A copied node keeps the mark of the version before it at this place.
            last = np.maximum.accumulate(np.where(full, np.arange(len(full)), -1))
            begin = np.maximum.accumulate(np.where(starts(spot), np.arange(len(spot)), 0))
            self.mark.append(np.where(last >= begin, version[np.maximum(last, 0)], -1))
            self.left.append(np.zeros(len(key), np.int64))
            self.right.append(np.zeros(len(key), np.int64))
            above, count = (tree[version], place, version, depth[tree[version]] > level), count + len(key)
            # Nodes painted in part go on to the children they reach.
            part = ~full
            version = np.repeat(version[part], 2)
            place = (2 * place[part][:, None] + np.arange(2)).ravel()
            shift = depth[tree[version]] - level - 1
            reached = (place << shift < high[version]) & ((place + 1) << shift > low[version])
            version, place = version[reached], place[reached]
        self.left, self.right, self.mark = map(np.concatenate, (self.left, self.right, self.mark))

    def _link(self, tree: np.ndarray, place: np.ndarray, version: np.ndarray, inner: np.ndarray, offset: np.ndarray, key: np.ndarray, n: int, count: int) -> None:
        """Point the level above at its children: of each place the last node up to the version."""
        for side, pointers in enumerate((self.left[-1], self.right[-1])):
            spot = offset[tree[inner]] + 2 * place[inner] + side
            at = np.searchsorted(key, spot * n + version[inner], "right") - 1
            there = (at >= 0) & (key[np.maximum(at, 0)] // n == spot) if len(key) else np.zeros(len(at), bool)
            pointers[inner] = np.where(there, at + count, 0)

    def find(self, version: np.ndarray, tree: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The last version that painted each leaf, as of the root of ``version``; -1 if none."""
        node, best = version + 1, np.full(len(version), -1)
        for level in range(int(self.depth.max(initial=0)) + 1):
            best = np.maximum(best, self.mark[node])
            shift = self.depth[tree] - level - 1
            right = (leaf >> np.maximum(shift, 0)) & 1 == 1
            node = np.where(shift < 0, 0, np.where(right, self.right[node], self.left[node]))
        return best


def search(entity: np.ndarray, known: np.ndarray, valid: np.ndarray, v_entity: np.ndarray, v_from: np.ndarray, v_to: np.ndarray, v_recorded: np.ndarray) -> np.ndarray:
    """For each event the position of its version, or -1.

    The versions must be sorted by entity and, within it, by the order in which a later one
    supersedes an earlier one, which has to begin with ``v_recorded``.
    """
    found = np.full(len(entity), -1)
    if not len(entity) or not len(v_entity):
        return found
    # The valid-time axis of each entity, cut at all ends of its intervals.
    ends_entity, ends_time = np.concatenate([v_entity, v_entity]), np.concatenate([v_from, v_to])
    (end_rank, valid_rank, from_rank, to_rank), size = ranks(ends_time, valid, v_from, v_to)
    axis = np.unique(ends_entity * size + end_rank)
    axis_entity = axis // size
    v_start = np.flatnonzero(starts(v_entity))
    first_axis = np.searchsorted(axis_entity, v_entity[v_start])
    leaves = np.searchsorted(axis_entity, v_entity[v_start], "right") - first_axis
    group = np.cumsum(starts(v_entity)) - 1
    low = np.searchsorted(axis, v_entity * size + from_rank) - first_axis[group]
    high = np.searchsorted(axis, v_entity * size + to_rank) - first_axis[group]

    depth = np.ceil(np.log2(np.maximum(leaves, 1))).astype(np.int64)
    forest = Forest(group, low, high, depth)

    # The root of each event's known time, and its leaf.
    (recorded_rank, known_rank), size_k = ranks(v_recorded, known)
    at = np.searchsorted(v_entity * size_k + recorded_rank, entity * size_k + known_rank, "right") - 1
    mine = (at >= 0) & (v_entity[np.maximum(at, 0)] == entity)
    g = group[np.maximum(at, 0)]
    leaf = np.searchsorted(axis, entity * size + valid_rank, "right") - 1 - first_axis[g]
    mine &= leaf >= 0
    which = np.flatnonzero(mine)
    found[which] = forest.find(at[which], g[which], leaf[which])
    return found


def _together(left: DataFrame, right: DataFrame, keys: list[str], groups: int, ids: list[str], carry: list[str], schema: T.StructType) -> DataFrame:
    """Events with their versions within each combination of ``keys``: columns ``ids`` and ``carry``.

    Combinations are spread by hash over ``groups`` groups of one task each.
    """

    def join(events: pa.Table, versions: pa.Table) -> pa.Table:
        e, v = events.num_rows, versions.num_rows
        both = codes(*[pa.chunked_array(events[k].chunks + versions[k].chunks, type=events.schema.field(k).type) for k in keys])
        order = np.lexsort([codes_of(versions["vid"]), longs(versions["of"]), longs(versions["rec"]), both[e:]])
        at = search(both[:e], longs(events["known"]), longs(events["valid"]), both[e:][order], longs(versions["vf"])[order], longs(versions["vt"])[order], longs(versions["rec"])[order])
        hit = np.flatnonzero(at >= 0)
        picked = events.select(ids).take(pa.array(hit))
        got = versions.select(carry).take(pa.array(order[at[hit]] if v else hit))
        return pa.table([*picked.columns, *got.columns], names=schema.names)

    placed = [df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).groupBy("shard") for df in (left, right)]
    return placed[0].cogroup(placed[1]).applyInArrow(join, schema)


def _of_hot(left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str], ids: list[str], carry: list[str], slice_rows: int) -> DataFrame:
    """The join for entities with more rows than one group may have.

    The valid time of an entity is cut into slices, the leaves of a binary tree. A version goes to
    the slices its ends lie in, and to the few nodes that together make up the slices between; an
    event to its slice and to the nodes above it. In a node every version covers every
    event, so nodes can be cut once more, by the time at which things become known: a part needs its
    own versions and the last of those known before. All groups stay bounded, a row is copied
    as often as the tree is high, and of an event's finds the last recorded is the one.
    """
    most, total = hot.agg(F.max("n"), F.sum("n")).first()
    # Cells of half a group's rows, so that those which a hash puts together stay near the bound.
    groups_of, slice_rows = slice_rows, max(1, slice_rows // 2)
    # Each version counts with both its ends, so a slice holds about slice_rows of either kind.
    of_valid = left.select(*keys, F.col("valid").alias("t")).unionByName(right.select(*keys, F.explode(F.array("vf", "vt")).alias("t")))
    of_known = left.select(*keys, F.col("known").alias("t")).unionByName(right.select(*keys, F.col("rec").alias("t")))
    by_valid = cut_points(of_valid, hot, keys, "t", most=most, slice_rows=slice_rows).withColumnRenamed("cuts", "v_cuts")
    by_known = cut_points(of_known, hot, keys, "t", most=most, slice_rows=slice_rows).withColumnRenamed("cuts", "k_cuts")
    cuts = cut(by_valid.join(by_known, keys))
    finest = max(1, -(-most // slice_rows))
    height = finest.bit_length()
    place = lambda c, of: slice_of(F.col(c), F.col(of), finest)
    levels = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")
    none = F.lit(-1).alias("level")

    # Repeated events are looked up once.
    counted = left.groupBy(*keys, *ids, "valid", "known").agg(F.count(F.lit(1)).alias("times"))
    events = counted.join(cuts, keys).withColumn("s", place("valid", "v_cuts")).withColumn("part", place("known", "k_cuts")).drop("v_cuts", "k_cuts")
    own = events.select("*", none, F.col("s").alias("node")).withColumn("part", F.lit(0))
    above = events.select("*", levels).withColumn("node", F.expr("shiftright(s, level)"))
    asked = own.unionByName(above).drop("s")

    # Whole slices are [a, b); a version that begins or ends between cuts is in part in that slice.
    of_v = lambda c: slice_of(c, F.col("v_cuts"), finest)
    versions = right.join(cuts, keys).withColumn("i", of_v(F.col("vf"))).withColumn("j", of_v(F.col("vt") - 1)).withColumn("part", place("rec", "k_cuts"))
    versions = versions.withColumn("a", F.col("i") + F.when(of_v(F.col("vf") - 1) < F.col("i"), 0).otherwise(1)).withColumn("b", F.col("j") + F.when((F.col("vt") == OPEN) | (of_v(F.col("vt")) > F.col("j")), 1).otherwise(0)).drop("v_cuts", "k_cuts")
    there = lambda c: F.filter(F.array_distinct(c), lambda x: x.isNotNull())
    ends = versions.select("*", none, F.explode(there(F.array(F.when(F.col("a") > F.col("i"), F.col("i")), F.when(F.col("b") == F.col("j"), F.col("j"))))).alias("node")).withColumn("part", F.lit(0)).drop("i", "j", "a", "b")
    # The nodes that make up [a, b): on each level at most one at either side.
    between = versions.filter("a < b").select("*", levels).withColumn("a", F.expr("shiftright(a + shiftleft(1, level) - 1, level)")).withColumn("b", F.expr("shiftright(b, level)"))
    sides = there(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))
    inner = between.filter("a < b").withColumn("node", F.explode(sides)).withColumn("vf", F.lit(-OPEN)).withColumn("vt", F.lit(OPEN)).drop("i", "j", "a", "b")
    # Of versions recorded at the same time, in bulk, a node needs the greatest.
    same = [*keys, "level", "node", "part", "rec"]
    others = [c for c in inner.columns if c not in same]
    inner = inner.groupBy(*same).agg(F.max_by(F.struct(*others), F.struct("of", "vid")).alias("v")).select(*same, *[F.col(f"v.{c}").alias(c) for c in others])
    # The last version known before each part that events ask for.
    cell = [*keys, "level", "node"]
    rest = [c for c in inner.columns if c not in cell and c != "part"]
    last = inner.groupBy(*cell, "part").agg(F.max_by(F.struct(*rest), F.struct("rec", "of", "vid")).alias("v"))
    wanted = above.select(*cell, "part").distinct().withColumn("asked", F.lit(True))
    before = F.last("v", ignorenulls=True).over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    known = wanted.join(last, [*cell, "part"], "full_outer").withColumn("v", before).filter("asked and v is not null").select(*cell, "part", *[F.col(f"v.{c}").alias(c) for c in rest])
    given = ends.unionByName(inner).unionByName(known)

    back = [*keys, *ids, "valid", "known", "times"]
    finds = [*carry, "rec", "of", "vid"]
    schema = T.StructType([asked.schema[c] for c in back] + [given.schema[c] for c in finds])
    found = _together(asked, given, [*keys, "level", "node", "part"], -(-total * (height + 2) // groups_of), back, finds, schema)
    best = found.groupBy(*back).agg(F.max_by(F.struct(*carry) if carry else F.struct(F.lit(1)), F.struct("rec", "of", "vid")).alias("v"))
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*ids, *[F.col(f"v.{c}").alias(c) for c in carry])


def known_as_of(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: list[str],
    event_id: list[str],
    valid_at: str,
    known_at: str,
    valid_from: str,
    valid_to: str,
    recorded_at: str,
    version_id: str,
    carry: list[str],
    weights: DataFrame | None = None,
    expected_rows: int | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Join each event with the version that was known and valid at its time.

    Of an entity's versions with valid_from <= valid_at < valid_to (null = open) and recorded_at
    <= known_at the last by (recorded_at, valid_from, version_id) is taken. Versions with a null
    or empty interval or a null recorded_at, and events with a null time, match nothing; a null in
    an entity column is no entity. Returns ``event_id + carry`` columns of the matched events,
    once each time an event row occurs. All other columns on either side are ignored, so their
    names can't clash; a ``carry`` column named like an event column comes out as ``version_<name>``.

    Entities are spread over tasks by hash in groups of about ``shard_rows`` events and versions
    together. Entities that alone have more are cut in both times (see :func:`_of_hot`), so a
    group is bounded by ``shard_rows`` whatever the skew; only events of one entity at the same
    microsecond stay together. ``weights`` (entity + n) bounds the
    entities' numbers of events, ``expected_rows`` their sum; without them the events are counted,
    which reads them once more.
    """
    if weights is None:
        weights = events.groupBy(*entity).agg(F.count(F.lit(1)).alias("n"))
    if expected_rows is None:
        expected_rows = weights.agg(F.sum("n")).first()[0] or 0
    keys, ids, kept = ([f"{x}{i}" for i in range(len(names))] for x, names in (("k", entity), ("e", event_id), ("c", carry)))
    own = versions.dropna(subset=[*entity, valid_from, recorded_at]).filter(F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from)))
    own = own.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], *[F.col(c).alias(n) for c, n in zip(carry, kept)], F.unix_micros(valid_from).alias("vf"), F.coalesce(F.unix_micros(valid_to), F.lit(OPEN)).alias("vt"), F.unix_micros(recorded_at).alias("rec"), F.col(version_id).alias("vid"))
    right = cut(own.withColumn("of", F.col("vf")))  # counted, then read, and as a rule the outcome of a longer plan
    left = events.dropna(subset=[*entity, valid_at, known_at]).select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], *[F.col(c).alias(e) for c, e in zip(event_id, ids)], F.unix_micros(valid_at).alias("valid"), F.unix_micros(known_at).alias("known"))
    rows = weights.dropna(subset=entity).select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], "n").unionByName(right.select(*keys, F.lit(1).cast("long").alias("n")))
    hot = cut(rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > shard_rows))
    fields = [T.StructField(n, left.schema[n].dataType) for n in ids] + [T.StructField(n, right.schema[n].dataType) for n in kept]
    schema = T.StructType(fields)
    groups = max(1, -(-(expected_rows + right.count()) // shard_rows))
    if hot.isEmpty():
        found = _together(left, right, keys, groups, ids, kept, schema)
    else:
        left = cut(left)  # read several times from here on
        few = [df.join(hot.select(*keys), keys, "left_anti") for df in (left, right)]
        many = [df.join(hot.select(*keys), keys, "left_semi") for df in (left, right)]
        found = _together(*few, keys, groups, ids, kept, schema).unionByName(_of_hot(*many, hot, keys, ids, kept, shard_rows))
    return found.select(*[F.col(e).alias(n) for e, n in zip(ids, event_id)], *[F.col(c).alias(n if n not in event_id else f"version_{n}") for c, n in zip(kept, carry)])


def codes_of(ids: pa.ChunkedArray) -> np.ndarray:
    """Ordered numbers of version ids of any sortable type."""
    if pa.types.is_integer(ids.type):
        return longs(ids)
    values = ids.combine_chunks()
    order = values.to_pandas().rank(method="dense", na_option="top")
    return order.to_numpy().astype(np.int64)


def usable(versions: DataFrame, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Rows whose half-open validity makes sense: a start, and no end or a later one."""
    return versions.filter(F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from))))

