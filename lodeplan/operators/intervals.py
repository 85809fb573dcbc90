"""Overlapping and gapped time intervals per entity.

Time is exact to the microsecond: an interval is a bitmap of microseconds, kept as its runs of set
bits. Every entity's axis is cut into time shards, and in each shard the bitmaps of its intervals are
united pair by pair. With every union ``once = a | b`` goes ``twice |= a & b``, so that the set runs of
``once`` are continuous periods, its clear runs between set ones are gaps, and the set runs of ``twice``
are overlaps. Runs inside a shard are final; those at shard edges are stitched.

Shards are as wide as ``shard_us`` where intervals are few and narrower where they are dense: one with
too many ends is divided, and its parts again, until each has few enough. So a dense entity, or a
dense hour of it, is spread over many tasks.

An interval touches the shards of its two ends only. The shards between are covered in full and
are counted by +1/-1 marks and a running sum over the entity's shards, so long intervals
aren't copied into every shard.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.operators.arrays import codes, longs, starts
from lodeplan.sources.tables import cut

#: Widest time shard: 2^45 microseconds, some 407 days.
SHARD_US = 1 << 45
#: Ends of intervals from which on a shard is divided.
SHARD_ROWS = 50_000
#: Rows of one task's group of (entity, shard) pairs.
GROUP_ROWS = 50_000


class RunBitmaps:
    """Bitmaps of many keys as runs [lo, hi) of set bits, sorted by (key, lo) and never touching."""

    def __init__(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.key, self.lo, self.hi = key, lo, hi

    def _merge(self, other: "RunBitmaps", least: int) -> "RunBitmaps":
        """Bits that are set in at least so many of the two."""
        key = np.concatenate([self.key, self.key, other.key, other.key])
        at = np.concatenate([self.lo, self.hi, other.lo, other.hi])
        step = np.repeat([1, -1, 1, -1], [len(self.key), len(self.key), len(other.key), len(other.key)])
        order = np.lexsort([at, key])
        key, at, depth = key[order], at[order], np.cumsum(step[order])
        last = np.append(starts(key)[1:] | starts(at)[1:], True)[: len(key)]
        key, at, on = key[last], at[last], depth[last] >= least
        flips = on != np.append(False, on[:-1])[: len(on)]
        begins, ends = np.flatnonzero(flips & on), np.flatnonzero(flips & ~on)
        return RunBitmaps(key[begins], at[begins], at[ends])

    def __or__(self, other: "RunBitmaps") -> "RunBitmaps":
        return self._merge(other, 1)

    def __and__(self, other: "RunBitmaps") -> "RunBitmaps":
        return self._merge(other, 2)

    def half(self, odd: int) -> "RunBitmaps":
        """The bitmaps with an odd or even key, under half of it."""
        mine = self.key & 1 == odd
        return RunBitmaps(self.key[mine] >> 1, self.lo[mine], self.hi[mine])

    def clear_runs(self) -> "RunBitmaps":
        """The runs of clear bits between set ones."""
        i = np.flatnonzero(~starts(self.key))
        return RunBitmaps(self.key[i], self.hi[i - 1], self.lo[i])


def unite(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[RunBitmaps, RunBitmaps]:
    """Per key the bits set in one or more of its intervals, and those set in two or more."""
    order = np.argsort(key, kind="stable")
    key, lo, hi = key[order], lo[order], hi[order]
    first = np.flatnonzero(starts(key))
    number = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    rounds = int(number.max(initial=0)).bit_length()
    # One bitmap per interval; each round unites neighbours, all keys at once.
    once = RunBitmaps(key << rounds | number, lo, hi)
    twice = RunBitmaps(once.key[:0], lo[:0], hi[:0])
    for _ in range(rounds):
        a, b = once.half(0), once.half(1)
        twice = twice.half(0) | twice.half(1) | (a & b)
        once = a | b
    return once, twice


def set_runs(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs per key as maximal runs (touching ones merge), sorted by (key, start)."""
    once, _ = unite(key, lo, hi)
    return once.key, once.lo, once.hi


def covered_twice(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of what two or more of a key's intervals cover."""
    _, twice = unite(key, lo, hi)
    return twice.key, twice.lo, twice.hi


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns with those of the other side that carry an underscore; nulls match."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_{n}"]) for n in names])


def _place(df: DataFrame, at: str, name: str, k: list[str], shard_us: int, divided: list[DataFrame]) -> DataFrame:
    """``df`` with ``<name>_lo`` and ``<name>_hi``, the edges of the shard that ``at`` lies in.

    ``divided``: per level (k, lo, n), the shards of the level above that are cut into 2^n parts.
    """
    lo, hi = f"{name}_lo", f"{name}_hi"
    df = df.withColumn(lo, F.expr(f"{at} - pmod({at}, {shard_us}L)")).withColumn(hi, F.col(lo) + F.lit(shard_us))
    for level in divided:
        parts = level.select(*[F.col(n).alias(f"_{n}") for n in k], F.col("lo").alias(f"_{lo}"), F.col("n").alias("_n"))
        width = F.greatest(F.lit(1), F.call_function("shiftright", F.col(hi) - F.col(lo), F.col("_n")))
        begin = F.when(F.col("_n").isNull(), F.col(lo)).otherwise(F.col(lo) + F.expr(f"({at} - {lo}) div _width") * F.col("_width"))
        df = df.join(parts, _same(df, parts, [*k, lo]), "left").withColumn("_width", width).withColumn("_begin", begin)
        df = df.withColumn(hi, F.when(F.col("_n").isNull(), F.col(hi)).otherwise(F.least(F.col(hi), F.col("_begin") + F.col("_width")))).withColumn(lo, F.col("_begin"))
        df = df.drop(*[f"_{n}" for n in k], f"_{lo}", "_n", "_width", "_begin")
    return df


def _divisions(ends: DataFrame, k: list[str], shard_us: int, shard_rows: int) -> list[DataFrame]:
    """Which shards to divide, level by level, until none has more than ``shard_rows`` ends.

    Each level counts all ends in a combining aggregate and keeps the dense shards only; where
    there is none, which is the rule, the first count is the last. A shard is cut into as many parts
    as its ends ask for if they lie evenly, and ever finer from level to level where they don't, so
    that even ends at one microsecond take five levels at most.
    """
    divided: list[DataFrame] = []
    while True:
        counts = _place(ends, "t", "s", k, shard_us, divided).groupBy(*k, "s_lo", "s_hi").agg(F.count(F.lit(1)).alias("rows"))
        dense = counts.filter((F.col("rows") > shard_rows) & (F.col("s_hi") - F.col("s_lo") > 1))
        n = F.greatest(F.lit(4 << len(divided)), F.ceil(F.log2(F.col("rows") / max(1, shard_rows))) + 1)
        level = cut(dense.select(*k, F.col("s_lo").alias("lo"), F.least(n, F.lit(50)).cast("int").alias("n")))
        if level.isEmpty():
            return divided
        divided.append(level)


def interval_runs(intervals: DataFrame, *, entity: list[str], start: str, end: str, shard_rows: int = SHARD_ROWS, shard_us: int = SHARD_US, groups: int | None = None) -> DataFrame:
    """Periods, gaps and overlaps of each entity's half-open intervals.

    Returns ``(kind, *entity, from_us, to_us)``: ``period`` is each longest stretch covered
    throughout, ``gap`` each longest stretch covered by none between covered ones, ``overlap``
    each longest stretch covered by two or more throughout. ``to_us`` is -1 if open. A null end is
    open; rows with a null start or an end not after the start are ignored, equal intervals count
    once, nulls in entity columns are values. Other columns are ignored. ``shard_us``: width of
    the widest time shard; ``shard_rows``: ends of intervals beyond which a shard is divided, down
    to a microsecond; ``groups``: number of task groups, by default from the number of rows.
    """
    k = [f"k{i}" for i in range(len(entity))]
    rows = (
        intervals.select(*[F.col(c).alias(n) for c, n in zip(entity, k)], F.unix_micros(start).alias("a"), F.unix_micros(end).alias("b"), F.col(end).isNull().alias("open"))
        .filter(F.col("a").isNotNull() & (F.col("open") | (F.col("b") > F.col("a"))))
        .select(*k, "a", "b")
    )
    distinct = cut(rows.distinct())
    if groups is None:
        groups = max(1, -(-2 * distinct.count() // GROUP_ROWS))
    ends = distinct.select(*k, F.explode(F.filter(F.array("a", F.col("b") - 1), lambda t: t.isNotNull())).alias("t"))
    divided = _divisions(ends, k, shard_us, shard_rows)
    placed = _place(distinct, "a", "a", k, shard_us, divided)
    placed = _place(placed.withColumn("z", F.col("b") - 1), "z", "z", k, shard_us, divided)
    # Each interval's parts in the shards of its ends, and the marks for the shards between.
    no = F.lit(None).cast("long")
    here = F.struct(F.col("a_lo").alias("shard"), F.col("a_hi").alias("edge"), F.col("a").alias("lo"), F.least("b", "a_hi").alias("hi"), F.lit(0).alias("delta"))
    there = F.struct(F.col("z_lo").alias("shard"), F.col("z_hi").alias("edge"), F.col("z_lo").alias("lo"), F.col("b").alias("hi"), F.lit(-1).alias("delta"))
    between = F.struct(F.col("a_hi").alias("shard"), no.alias("edge"), no.alias("lo"), no.alias("hi"), F.lit(1).alias("delta"))
    parts = placed.select(*k, F.inline(F.when(F.col("z_lo") == F.col("a_lo"), F.array(here)).when(F.col("b").isNull(), F.array(here, between)).otherwise(F.array(here, there, between))))
    shards = cut(parts.groupBy(*k, "shard").agg(F.sum("delta").alias("delta"), F.count("lo").alias("n"), F.max("edge").alias("edge")))
    w = Window.partitionBy(*k).orderBy("shard")
    so_far = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # full: intervals that cover the whole shard; through: those that cover the axis from the end
    # of the shard before in this list up to this one.
    marked = shards.withColumn("full", so_far).withColumn("through", F.col("full") - F.col("delta")).filter("n > 0")
    whole = marked.filter("full > 0").select(*k, "shard", "edge", F.col("shard").alias("lo"), F.col("edge").alias("hi"), F.explode(F.sequence(F.lit(1), F.least(F.col("full"), F.lit(2)))).alias("_")).drop("_")
    bits = parts.filter(F.col("lo").isNotNull()).select(*k, "shard", "edge", "lo", "hi").unionByName(whole).withColumn("grp", F.pmod(F.xxhash64(*k, "shard"), F.lit(groups)).cast("int"))

    key_fields = [T.StructField(n, distinct.schema[n].dataType) for n in k]
    schema = T.StructType([T.StructField("kind", T.StringType()), *key_fields, *[T.StructField(n, T.LongType()) for n in ("shard", "edge", "lo", "hi")], *[T.StructField(n, T.BooleanType()) for n in ("at_lo", "at_hi", "final")]])

    def runs(table: pa.Table) -> pa.Table:
        own = codes(*[table[n] for n in [*k, "shard"]])
        sample = np.unique(own, return_index=True)[1]  # a row of each (entity, shard)
        base, edge = longs(table["shard"])[sample], longs(table["edge"])[sample]
        # Bits are microseconds from the shard's lower edge.
        once, twice = unite(own, longs(table["lo"]) - base[own], longs(table["hi"]) - base[own])
        gaps = once.clear_runs()
        out: list[pa.Table] = []
        for kind, found in (("period", once), ("overlap", twice), ("gap", gaps)):
            key, lo, hi = found.key, found.lo + base[found.key], found.hi + base[found.key]
            at_lo, at_hi = lo == base[key], hi == edge[key]
            if kind == "period":
                # The first and last period of a shard meet other shards; those between are final.
                first = starts(key)
                final = ~(first | np.append(first[1:], True)[: len(key)])
            else:
                final = ~(at_lo | at_hi)  # a gap in a shard lies between two of its periods
            rows = table.select([*k, "shard", "edge"]).take(pa.array(sample[key]))
            out.append(pa.table([pa.array([kind] * len(key), pa.string()), *rows.columns, *map(pa.array, (lo, hi, at_lo, at_hi, final))], names=schema.names))
        return pa.concat_tables(out)

    found = cut(bits.groupBy("grp").applyInArrow(runs, schema))
    edges = found.filter("not final")
    own = marked.select(*[F.col(n).alias(f"_{n}") for n in (*k, "shard")], "through")
    stitched = edges.join(own, _same(edges, own, [*k, "shard"])).drop(*[f"_{n}" for n in (*k, "shard")])
    # A run goes on from the one before if both meet at a common shard edge, or if intervals
    # cover all the axis between their shards.
    by = Window.partitionBy("kind", *k).orderBy("lo")
    need = F.when(F.col("kind") == "overlap", 2).otherwise(1)
    before = lambda n: F.lag(n).over(by)
    goes_on = F.when(before("shard") == F.col("shard"), F.lit(False)).when(before("edge") == F.col("shard"), F.col("at_lo") & before("at_hi")).otherwise(F.col("through") >= need)
    islands = (
        stitched.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("kind", *k, "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("shard", "at_hi")).alias("end"))
    )
    # What reaches the end of an entity's last shard and is still covered there is open.
    open_ends = shards.groupBy(*[F.col(n).alias(f"_{n}") for n in k]).agg(F.sum("delta").alias("open_n"), F.max(F.when(F.col("n") > 0, F.col("shard"))).alias("last_shard"))
    is_open = F.col("end.at_hi") & (F.col("end.shard") == F.col("last_shard")) & (F.col("open_n") >= need)
    ended = islands.join(open_ends, _same(islands, open_ends, k), "left").select("kind", *k, "lo", F.when(F.coalesce(is_open, F.lit(False)), F.lit(-1)).otherwise(F.col("hi")).alias("hi"))
    # Gaps between the stitched periods, unless final periods of a shard lie between, whose own
    # gaps are in already: those join a shard's first and last period, so only consecutive
    # periods of different shards are looked at.
    periods = stitched.filter("kind = 'period'").withColumn("go", goes_on)
    gaps = (
        periods.select(*k, "shard", "lo", "go", before("hi").alias("before"), before("shard").alias("before_shard"))
        .filter(F.col("before").isNotNull() & (F.col("shard") != F.col("before_shard")) & ~F.coalesce("go", F.lit(False)) & (F.col("before") < F.col("lo")))
        .select(F.lit("gap").alias("kind"), *k, F.col("before").alias("lo"), F.col("lo").alias("hi"))
    )
    result = found.filter("final").select("kind", *k, "lo", "hi").unionByName(ended.select("kind", *k, "lo", "hi")).unionByName(gaps)
    return result.select("kind", *[F.col(n).alias(c) for n, c in zip(k, entity)], F.col("lo").alias("from_us"), F.col("hi").alias("to_us"))
