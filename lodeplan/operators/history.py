"""History of changing entity attributes: a bitemporal ledger from an update feed.

Every attribute of an entity has a timeline of its own, and so has the question whether the entity
exists at all. A ledger row says what was believed of one timeline for a stretch of valid time, from
when to when it was believed. Updates are applied in the order they were received. A late one splits
the stretch it falls into; what it sends holds up to the next update that sends the same attribute, so
three stretches at most are closed and three written, however long the history is. Rows that no
longer hold are closed (``recorded_to_us``), never overwritten.

Updates are laid out in ranges of (entity, valid time) of bounded size. An entity with very many
updates lies in several ranges, whose timelines are worked on apart: a range's last stretch
is left open and ends where the entity's next one begins, which is settled when the ledger is read,
from one summary row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.functions.keys import folded
from lodeplan.operators.arrays import codes, longs, starts
from lodeplan.operators.slots import Slots
from lodeplan.sources.tables import by_range

#: Updates of one range.
SHARD_ROWS = 50_000
#: Codes beside those of values: unknown, no statement at all, not sent.
UNKNOWN, NOTHING, UNSENT = -1, -2, -3
#: The timeline that says whether the entity exists.
ALIVE = "alive"


class Timelines:
    """One attribute of many entities, and the ledger rows that its updates leave.

    ``entity`` numbers the entity of each point, points being sorted by entity and time. Points at
    which the attribute was sent are in ``sent``; those that begin a stretch are in ``heads``.
    """

    def __init__(self, entity: list[int]) -> None:
        n = len(entity)
        self.entity, self.sent, self.heads = entity, Slots(n), Slots(n)
        self.value, self.row = [UNSENT] * n, [-1] * n
        self.begin: list[int] = []
        self.end: list[int] = []  # the point at which the stretch ends, -1 if it is the last
        self.code: list[int] = []
        self.source: list[int] = []  # the update that stated it
        self.made: list[int] = []  # the update that wrote the row, and the one that closed it, or -1
        self.closed: list[int] = []

    def _near(self, found: int, point: int) -> int:
        return found if found >= 0 and self.entity[found] == self.entity[point] else -1

    def _write(self, begin: int, end: int, code: int, source: int, update: int) -> None:
        self.row[begin] = len(self.begin)
        self.begin.append(begin)
        self.end.append(end)
        self.code.append(code)
        self.source.append(source)
        self.made.append(update)
        self.closed.append(-1)

    def apply(self, update: int, point: int, code: int) -> None:
        """The update states ``code`` at ``point``; UNSENT takes back what was sent there."""
        was = self.value[point]
        if was == code:
            return
        before = self._near(self.sent.before(point), point)
        left = self.value[before] if before >= 0 else NOTHING
        old, new = (left if was == UNSENT else was), (left if code == UNSENT else code)
        (self.sent.remove if code == UNSENT else self.sent.add)(point)
        self.value[point] = code
        if old == new:
            return
        # The stretch [head, end) of ``old`` loses [point, then).
        was_head = old != left
        head = point if was_head else self._near(self.heads.before(point), point)
        end = self._near(self.heads.after(point), point)
        then = self._near(self.sent.after(point), point)
        if old != NOTHING:
            source = self.source[self.row[head]]
            self.closed[self.row[head]] = update
            if head < point:
                self._write(head, point, old, source, update)
            if then >= 0 and then != end:
                self.heads.add(then)
                self._write(then, end, old, source, update)
                end = then
        if end >= 0 and end == then and self.value[end] == new:
            self.closed[self.row[end]] = update
            self.heads.remove(end)
            end = self._near(self.heads.after(end), point)
        if new != left:
            self.heads.add(point)
            self._write(point, end, new, update, update)
        else:
            self.heads.remove(point)
            if left != NOTHING:
                head = self._near(self.heads.before(point), point)
                source = self.source[self.row[head]]
                self.closed[self.row[head]] = update
                self._write(head, end, left, source, update)


def build_ledger(updates: DataFrame, *, entity: list[str], at: str, received: str, row: str, is_delete: Column, attributes: list[str], shard_rows: int = SHARD_ROWS, groups: int | None = None) -> DataFrame:
    """The bitemporal ledger of an update feed.

    Of the rows of one entity and valid time ``at`` the last by (received, row) counts; a null
    attribute means not sent. Rows with a null in ``entity``, ``at`` or ``received`` state nothing
    that could be placed and are ignored, as are other columns. Returns ``entity`` and

    * ``timeline``: the attribute the row is about, or ``alive``;
    * ``valid_from_us``, ``valid_to_us`` (null: until the timeline's next row of the same belief);
    * ``alive`` (false from a delete on) and the attributes, of which only the timeline's own is
      filled; a null there means unknown;
    * ``recorded_from_us``, ``recorded_to_us`` (null: still believed), and ``row``, the update
      that made it so;
    * ``slice``, the range it comes from, and ``split``, whether its entity may lie in others too.

    ``groups``: number of ranges, by default one per ``shard_rows`` updates. Rows of one entity and
    one microsecond stay together.
    """
    k = [f"k{i}" for i in range(len(entity))]
    a = [f"a{i}" for i in range(len(attributes))]
    rows = updates.select(*[F.col(c).alias(n) for c, n in zip(entity, k)], F.unix_micros(at).alias("at"), F.unix_micros(received).alias("rec"), F.col(row).alias("rid"), F.coalesce(is_delete, F.lit(False)).alias("gone"), *[F.col(c).alias(n) for c, n in zip(attributes, a)]).dropna(subset=[*k, "at", "rec"])
    if groups is None:
        groups = max(1, -(-updates.count() // shard_rows))
    placed = by_range(rows, groups, *k, "at")
    fields = [T.StructField(n, rows.schema[n].dataType) for n in k] + [T.StructField("timeline", T.StringType())]
    fields += [T.StructField(n, T.LongType()) for n in ("valid_from_us", "valid_to_us", "recorded_from_us", "recorded_to_us")] + [T.StructField("alive", T.BooleanType())]
    fields += [T.StructField(n, rows.schema[n].dataType) for n in a] + [T.StructField("row", rows.schema["rid"].dataType), T.StructField("slice", T.IntegerType()), T.StructField("split", T.BooleanType())]
    schema = T.StructType(fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        key, at = codes(*[table[n] for n in k]), longs(table["at"])
        rid = table["rid"].combine_chunks()
        row_rank = longs(rid) if pa.types.is_integer(rid.type) else rid.to_pandas().rank(method="dense", na_option="top").to_numpy()
        # Points of time per entity, and the updates in the order they were received.
        by_point = np.lexsort([at, key])
        new = starts(key[by_point]) | starts(at[by_point])
        point = np.empty(len(key), np.int64)
        point[by_point] = np.cumsum(new) - 1
        sample = by_point[new]  # a row of each point
        order = np.lexsort([row_rank, longs(table["rec"])])
        # Entities at the edges of a range may go on in the next one.
        in_range = table.select(k).take(pa.array(sample)).sort_by([(n, "ascending") for n in k])
        split = np.zeros(len(key), bool)
        if groups > 1:
            for edge in (in_range.slice(0, 1), in_range.slice(len(in_range) - 1)):
                same = [pc.equal(table[n], edge[n][0]).combine_chunks() for n in k]
                split |= np.logical_and.reduce([s.to_numpy(zero_copy_only=False) for s in same])
        entity_of, received_at = key[sample].tolist(), longs(table["rec"])
        gone = table["gone"].to_numpy()
        for j, name in enumerate([*attributes, ALIVE]):
            if name == ALIVE and j == len(attributes):
                code = (~gone).astype(np.int64)
            else:
                encoded = pc.dictionary_encode(table[a[j]].combine_chunks())
                code = pc.fill_null(encoded.indices, UNSENT).to_numpy(zero_copy_only=False).astype(np.int64)
                code[gone] = UNKNOWN
            # What isn't sent matters only where something was sent for the same time.
            ever = np.zeros(len(sample), bool)
            ever[point[code != UNSENT]] = True
            mine = order[ever[point[order]]]
            lines = Timelines(entity_of)
            for update, p, c in zip(mine.tolist(), point[mine].tolist(), code[mine].tolist()):
                lines.apply(update, p, c)
            begin, end, source, made, closed = (np.array(x, np.int64) for x in (lines.begin, lines.end, lines.source, lines.made, lines.closed))
            value, where = np.array(lines.code, np.int64), sample[begin]
            filled = {n: pa.nulls(len(begin), table[n].type) for n in a}
            alive = pa.nulls(len(begin), pa.bool_())
            if j == len(attributes):
                alive = pa.array(value == 1)
            else:
                filled[a[j]] = encoded.dictionary.take(pa.array(value, mask=value < 0))
            columns = [*table.select(k).take(pa.array(where)).columns, pa.array([name] * len(begin), pa.string())]
            columns += [pa.array(at[where]), pa.array(at[sample[end]], mask=end < 0), pa.array(received_at[np.maximum(made, 0)]), pa.array(received_at[np.maximum(closed, 0)], mask=closed < 0), alive, *filled.values()]
            columns += [rid.take(pa.array(source)), table["slice"].take(pa.array(where)), pa.array(split[where])]
            yield from pa.table(columns, names=schema.names).combine_chunks().to_batches()

    made = placed.mapInArrow(apply, schema)
    return made.select(*[F.col(n).alias(c) for n, c in zip(k, entity)], "timeline", "valid_from_us", "valid_to_us", "recorded_from_us", "recorded_to_us", "alive", *[F.col(n).alias(c) for n, c in zip(a, attributes)], "row", "slice", "split")


def history(ledger: DataFrame, *, entity: list[str], attributes: list[str], fold: list[str] = (), as_of_us: int | None = None) -> DataFrame:
    """The versions a ledger states now, or as it was believed at ``as_of_us``.

    A version starts where the entity comes to life or an attribute differs from before (those in
    ``fold`` compared without outer white space and case) and ends at the next version or delete.
    Returns ``entity + attributes + [from_us, to_us]``; ``to_us`` is null while open. No update,
    no version.
    """
    believed = F.col("recorded_to_us").isNull() if as_of_us is None else (F.col("recorded_from_us") <= as_of_us) & (F.col("recorded_to_us").isNull() | (F.col("recorded_to_us") > as_of_us))
    k, v = [f"k{i}" for i in range(len(entity))], [f"v{i}" for i in range(len(attributes))]
    lines = dict(zip([ALIVE, *v], [ALIVE, *attributes]))
    stated = [F.when(F.col("timeline") == c, F.struct(F.col(c).alias("x"))).alias(n) for n, c in lines.items()]
    if ALIVE in attributes:
        raise ValueError(f"an attribute can't be called {ALIVE}")
    rows = ledger.filter(believed).select(*[F.col(c).alias(n) for c, n in zip(entity, k)], "slice", "split", F.col("valid_from_us").alias("at"), *stated)
    # One exchange by entity and range serves the merging of the timelines and the windows.
    merged = rows.repartition(*k, "slice").groupBy(*k, "slice", "split", "at").agg(*[F.max(n).alias(n) for n in lines])
    w = Window.partitionBy(*k, "slice", "split").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = Window.partitionBy(*k).orderBy("slice")
    earlier, later = chain.rowsBetween(Window.unboundedPreceding, -1), chain.rowsBetween(1, Window.unboundedFollowing)
    # What an entity that goes on from one range to the next takes over: one summary row per range.
    ends = rows.filter("split").groupBy(*k, "slice").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(n) for n in lines])
    carry = ends.select(*k, "slice", *[F.last(n, ignorenulls=True).over(earlier).alias(f"c_{n}") for n in lines])
    state = merged.join(carry, [*k, "slice"], "left")
    for n in lines:
        state = state.withColumn(n, F.coalesce(F.last(n, ignorenulls=True).over(so_far), f"c_{n}")["x"]).withColumn(f"c_{n}", F.col(f"c_{n}.x"))
    seen = lambda prefix: F.struct(*[(folded(F.col(f"{prefix}{n}")) if c in fold else F.col(f"{prefix}{n}")).alias(n) for n, c in zip(v, attributes)])
    first = F.row_number().over(w) == 1
    state = (
        state.withColumn("seen", seen(""))
        .withColumn("was", F.when(first, seen("c_")).otherwise(F.lag("seen").over(w)))
        .withColumn("was_alive", F.coalesce(F.when(first, F.col(f"c_{ALIVE}")).otherwise(F.lag(ALIVE).over(w)), F.lit(False)))
    )
    same = F.lit(True)
    for n in v:
        same = same & F.col(f"seen.{n}").eqNullSafe(F.col(f"was.{n}"))
    edges = state.filter(F.when(F.col(ALIVE), ~F.col("was_alive") | ~same).otherwise(F.col("was_alive"))).select(*k, "slice", "split", "at", ALIVE, *v)
    firsts = edges.filter("split").groupBy(*k, "slice").agg(F.min("at").alias("first_at"))
    after = ends.select(*k, "slice").join(firsts, [*k, "slice"], "left").select(*k, "slice", F.first("first_at", ignorenulls=True).over(later).alias("after"))
    versions = edges.withColumn("next", F.lead("at").over(w)).join(after, [*k, "slice"], "left").withColumn("to_us", F.coalesce("next", "after")).filter(ALIVE)
    return versions.select(*[F.col(n).alias(c) for n, c in zip(k, entity)], *[F.col(n).alias(c) for n, c in zip(v, attributes)], F.col("at").alias("from_us"), "to_us")
