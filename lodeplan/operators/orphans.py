"""References to records that don't exist, are gone or come later.

:class:`OrphanTracker` keeps pending-orphan state over batches of references and of parent
deliveries, full snapshots included: new references probe the parent index, arriving parents
resolve waiting references, deletions reopen settled ones, and a report can be taken after any
batch. :func:`snapshot_orphans` states the same for full snapshots that are all at hand, in one pass:
the state of a key is the set of snapshots that hold it.

Nothing is collected per key: the parent index is an aggregate with map-side combine, and the
references, which may be heavily skewed, only ever meet it in an equi-join whose result is written
before it is grouped, so that adaptive execution can split it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.functions.keys import salted
from lodeplan.functions.periods import utc_month
from lodeplan.sources.tables import remove, scratch

#: Batches whose parent deliveries are merged into one index.
COMPACT = 16
MISSING, DELETED, LATE = "missing", "deleted", "late"


def key_index(deliveries: DataFrame, *, key: list[str], at: str, row: str, gone: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """One row per key: ``first_at`` (its arrival) and ``last`` (its current delivery).

    ``last`` is a struct (at, row, gone, *carry), the greatest by (at, row). Rows with a null in
    ``key`` are no records and are left out. Indexes merge with :func:`merge_index`.
    """
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    present = deliveries.dropna(subset=key)
    last = F.struct(F.col(at).alias("at"), F.col(row).alias("row"), gone.alias("gone"), *carry)
    return present.select(*key, F.col(at).alias("at"), last.alias("last")).groupBy(*key).agg(F.min("at").alias("first_at"), F.max("last").alias("last"))


def merge_index(a: DataFrame | None, b: DataFrame, key: list[str]) -> DataFrame:
    """The index of both feeds together."""
    if a is None:
        return b
    return a.unionByName(b).groupBy(*key).agg(F.min("first_at").alias("first_at"), F.max("last").alias("last"))


def verdict(child_at: Column, parent_at: Column, parent_gone: Column) -> Column:
    """Why a reference dangles, or null if it holds. ``parent_gone`` is null only for an absent parent; nothing is late without both times."""
    return F.when(parent_gone.isNull(), MISSING).when(parent_gone, DELETED).when(parent_at > child_at, LATE)


@dataclass(frozen=True)
class OrphanTracker:
    """Pending-orphan state of one reference field after a number of batches.

    ``key`` names the columns shared by references and parents, ``child`` the columns that
    identify a reference's owner. The state lies in ``folder`` on shared storage:

    * ``parents/batch=i``: what batch i delivered of the parents, one row per key; every COMPACT
      batches the deliveries so far are merged into ``base/upto=i``;
    * ``references/batch=i/dangling=true``: the waiting references after batch i, with reasons;
    * ``references/batch=i/dangling=false``: references that batch i settled, kept only if
      ``settles``, to be found again when their parent is deleted;
    * ``deleted/batch=i``, ``withdrawn/batch=i``: keys and children whose settled references of
      earlier batches no longer count.

    A batch writes its own parts only. It reads the waiting references, of the parent index
    the buckets its keys fall in, and settled references only of buckets in which it deletes
    a parent. Everything that has to be judged meets the index in one join, which adaptive execution
    can split at hot keys, since its result is written before anything is grouped.

    ``pinned``: references hold or dangle by the batch they come with; only a missing parent that
    arrives later changes the verdict, and parents a batch doesn't deliver count as gone for its
    references (full snapshots). ``settles``: whether parents can be deleted after a
    reference was settled. ``buckets``: hash buckets of keys; 1 for batches so large that they
    touch all.

    A child delivered repeatedly keeps every delivery that dangles. That is exact and spares an
    aggregation of all references: of two deliveries of one child to one key the earlier dangles
    whenever the later does, so the report only has to take the earliest of the dangling ones.
    """

    key: list[str]
    child: list[str]
    pinned: bool = False
    settles: bool = True
    buckets: int = 1
    folder: str | None = None
    batch: int = -1
    schema: T.StructType | None = None
    index_schema: T.StructType | None = None
    spark: SparkSession | None = None

    def _columns(self) -> list[str]:
        return [*self.child, *[k for k in self.key if k not in self.child]]

    def _bucket(self) -> Column:
        return salted(self.buckets, *self.key)

    def _read(self, spark: SparkSession, part: str, schema: T.StructType, *partitions: str) -> DataFrame:
        kinds = {"dangling": T.BooleanType()}
        return spark.read.schema(T.StructType([*schema.fields, *[T.StructField(p, kinds.get(p, T.IntegerType())) for p in partitions]])).parquet(f"{self.folder}/{part}")

    def index(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """One row per parent key delivered so far (see :func:`key_index`), of some buckets or all."""
        base = (self.batch + 1) // COMPACT * COMPACT - 1
        parts = self._read(spark, "parents", self.index_schema, "batch", "bucket").filter((F.col("batch") > base) & (F.col("batch") <= self.batch)).drop("batch")
        if base >= 0:
            parts = parts.unionByName(self._read(spark, f"base/upto={base}", self.index_schema, "bucket"))
        if buckets is not None and self.buckets > 1:
            parts = parts.filter(F.col("bucket").isin(buckets))
        parts = parts.drop("bucket")
        return parts if self.batch == 0 else parts.groupBy(*self.key).agg(F.min("first_at").alias("first_at"), F.max("last").alias("last"))

    def waiting(self, spark: SparkSession) -> DataFrame:
        """The dangling references: child, key, at, reason."""
        if self.schema is None:
            return spark.read.parquet(f"{self.folder}/references/batch={self.batch}/dangling=true").drop("bucket")
        return self._read(spark, f"references/batch={self.batch}", self.schema, "dangling", "bucket").filter("dangling").drop("dangling", "bucket")

    def _settled(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """References that hold, of some buckets."""
        rows = self._read(spark, "references", self.schema, "batch", "dangling", "bucket").filter(~F.col("dangling") & (F.col("batch") <= self.batch) & F.col("bucket").isin(buckets))
        for part, columns in (("deleted", self.key), ("withdrawn", self.child)):
            logged = self._read(spark, part, T.StructType([self.schema[c] for c in columns]), "batch").filter(F.col("batch") <= self.batch).select(*[F.col(c).alias(f"_{c}") for c in columns], F.col("batch").alias("_batch"))
            on = F.col("batch") < F.col("_batch")
            for c in columns:
                on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
            rows = rows.join(logged, on, "left_anti")
        return rows.drop("batch", "dangling", "bucket")

    def advance(self, references: DataFrame, arrived: DataFrame, *, withdrawn: DataFrame | None = None, now: object = None, last: bool = False) -> "OrphanTracker":
        """The state after one more batch; the state before stays valid until the batch after next.

        ``references``: child + key + ``at`` columns of the new references (null keys are no
        references). ``arrived``: :func:`key_index` of the batch's parent deliveries. ``withdrawn``:
        children whose earlier references no longer count, as they are stated anew or not at all.
        ``now``: for pinned references, the ``at`` of the parents that the batch delivers. ``last``:
        no batch will follow, so settled references needn't be kept. The same batch may be
        repeated after a failure: it writes the same parts again.
        """
        spark, columns, batch = references.sparkSession, self._columns(), self.batch + 1
        fresh = references.dropna(subset=self.key).select(*columns, "at", F.lit(None).cast("string").alias("reason"))
        new = replace(self, folder=self.folder or scratch(spark, "orphans"), batch=batch, schema=fresh.schema, index_schema=arrived.schema, spark=spark)
        write = lambda df, part: df.write.mode("overwrite").partitionBy(*[p for p in ("dangling", "bucket") if p in df.columns]).parquet(f"{new.folder}/{part}")
        write(arrived.withColumn("bucket", self._bucket()), f"parents/batch={batch}")
        if (batch + 1) % COMPACT == 0:
            merged = replace(new, batch=batch - 1).index(spark).unionByName(self._own(new, spark)).groupBy(*self.key).agg(F.min("first_at").alias("first_at"), F.max("last").alias("last"))
            write(merged.withColumn("bucket", self._bucket()), f"base/upto={batch}")
        own = self._own(new, spark)
        touched, deleting = None, []
        if self.buckets > 1:
            touched = [r[0] for r in own.select(self._bucket()).union(fresh.select(self._bucket())).distinct().collect()]
        judged = fresh.withColumn("fresh", F.lit(True))
        if batch > 0:
            before = self._with(new).waiting(spark)
            if withdrawn is not None:
                before = before.join(withdrawn.select(*self.child), self.child, "left_anti")
            judged = judged.unionByName(before.withColumn("fresh", F.lit(False)))
        if self.settles:
            gone = own.filter("last.gone").select(*self.key)
            write(gone.coalesce(1), f"deleted/batch={batch}")
            write((references.select(*self.child).limit(0) if withdrawn is None else withdrawn.select(*self.child)), f"withdrawn/batch={batch}")
            if batch > 0:
                deleting = [r[0] for r in gone.select(self._bucket()).distinct().collect()]
            if deleting:
                reopened = self._with(new)._settled(spark, deleting).join(gone, self.key, "left_semi")
                if withdrawn is not None:
                    reopened = reopened.join(withdrawn.select(*self.child), self.child, "left_anti")
                judged = judged.unionByName(reopened.withColumn("fresh", F.lit(False)))
        absent = F.lit(False) if now is None else F.col("last.at") < F.lit(now)
        # No delivery has a null in ``gone``, so it marks a parent's presence whatever its times.
        found = new.index(spark, touched).select(*self.key, F.col("first_at").alias("_at"), (F.col("last.gone") | absent).alias("_gone"))
        verdict_now = verdict(F.col("at"), F.col("_at"), F.col("_gone"))
        if self.pinned:
            verdict_now = F.when(F.col("fresh") | (F.col("reason") == MISSING), verdict_now).otherwise(F.col("reason"))
        if touched is not None:
            verdict_now = F.when(F.col("fresh") | self._bucket().isin(touched), verdict_now).otherwise(F.col("reason"))
        state = judged.join(found, self.key, "left").withColumn("reason", verdict_now).select(*columns, "at", "reason").withColumn("dangling", F.col("reason").isNotNull()).withColumn("bucket", self._bucket())
        write(state if self.settles and not last else state.filter("dangling"), f"references/batch={batch}")
        # What a repetition of this batch would read stays: the state before it.
        remove(spark, f"{new.folder}/references/batch={batch - 2}/dangling=true")
        if batch % COMPACT == 0:
            for old in range(max(0, batch - COMPACT), batch):
                remove(spark, f"{new.folder}/parents/batch={old}")
            remove(spark, f"{new.folder}/base/upto={batch - 1 - COMPACT}")
        return new

    def _with(self, new: "OrphanTracker") -> "OrphanTracker":
        return replace(self, folder=new.folder, schema=new.schema, index_schema=new.index_schema)

    def _own(self, new: "OrphanTracker", spark: SparkSession) -> DataFrame:
        return new._read(spark, f"parents/batch={new.batch}", new.index_schema, "bucket").drop("bucket")

    def delivered(self, spark: SparkSession) -> DataFrame:
        """The parent keys that the last batch delivered."""
        return self._own(self, spark).select(*self.key)

    def report(self) -> DataFrame:
        """child + key + (at, reason): one row per dangling child and key; ``at`` is its arrival, null only if no time is known."""
        columns = self._columns()
        return self.waiting(self.spark).groupBy(*columns).agg(F.min(F.struct(F.col("at").isNull().alias("untimed"), "at", "reason")).alias("x")).select(*columns, "x.at", "x.reason")

    def snapshot_counts(self, as_of: Column) -> DataFrame:
        """(as_of, period, reason, n): the dangling references of the state, by month of arrival."""
        return self.report().groupBy(as_of.alias("as_of"), utc_month(F.col("at")).alias("period"), "reason").agg(F.count(F.lit(1)).alias("n"))


def current_references(index: DataFrame, *, child: list[str], carry: str, key: str) -> DataFrame:
    """References stated by the current rows of a :func:`key_index`: gone rows state none."""
    return index.filter(~F.col("last.gone")).select(*child, F.col("first_at").alias("at"), F.col(f"last.{carry}").alias(key))


def snapshot_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Dangling references within full snapshots.

    ``references``: any columns but ``held`` and ``reason``, plus (ref_key, ord); ``parents``: (ref_key, ord), ord being the
    snapshot's ordinal. A reference dangles if its own snapshot doesn't hold the key: ``deleted``
    if an earlier one does, else ``late`` if a later one does, else ``missing``. The state of a
    key is the sorted set of its ordinals, as long as the list of snapshots at most. Null keys
    are no references; repeated references come out once.
    """
    state = parents.dropna(subset=["ref_key"]).select("ref_key", "ord").groupBy("ref_key").agg(F.collect_set("ord").alias("held"))
    reason = F.when(F.col("held").isNull(), MISSING).when(F.array_min("held") < F.col("ord"), DELETED).otherwise(LATE)
    return (
        references.dropna(subset=["ref_key"])
        .join(state, "ref_key", "left")
        .filter(F.col("held").isNull() | ~F.array_contains("held", F.col("ord")))
        .withColumn("reason", reason)
        .drop("held", "ord")
        .distinct()
    )
