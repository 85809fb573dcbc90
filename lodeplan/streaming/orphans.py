"""Orphan references over a stream of deliveries, exactly once per micro-batch.

The state (see :class:`~lodeplan.operators.orphans.OrphanTracker`) is kept as Parquet in a shared
folder; a micro-batch adds its own parts to it. A batch that is repeated after a failure starts from
the state before it and writes the same parts again, so counts never double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeplan.operators.orphans import OrphanTracker, key_index


class OrphanStream:
    """Tracks one reference field of a stream.

    The stream's rows are references and parent deliveries alike, told apart by the condition
    ``is_parent``; both have the ``key`` columns and ``at``, references also the ``child``
    columns, parents ``row``, by which equal times are ordered, and ``gone`` for deletions.
    ``folder`` must be one that all executors share and survive the query.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: list[str], child: list[str], at: str, row: str, is_parent: Column, gone: Column, buckets: int = 16) -> None:
        self.spark, self.folder, self.key, self.child, self.buckets = spark, folder, key, child, buckets
        self.schema = self.index_schema = None
        self.at, self.row, self.is_parent, self.gone = at, row, is_parent, gone

    def state(self, batch: int) -> OrphanTracker:
        """The state after a batch; before the first there is none."""
        return OrphanTracker(self.key, self.child, buckets=self.buckets, folder=f"{self.folder}/state", batch=batch, schema=self.schema, index_schema=self.index_schema, spark=self.spark)

    def process(self, rows: DataFrame, batch: int) -> None:
        """Advance the state by one micro-batch and add its counts to ``counts``."""
        rows = rows.withColumn("_parent", F.coalesce(self.is_parent, F.lit(False)))
        arrived = key_index(rows.filter("_parent"), key=self.key, at=self.at, row=self.row, gone=self.gone)
        references = rows.filter("not _parent").withColumnRenamed(self.at, "at") if self.at != "at" else rows.filter("not _parent")
        new = self.state(batch - 1).advance(references, arrived)
        self.schema, self.index_schema = new.schema, new.index_schema
        new.snapshot_counts(F.lit(batch)).drop("as_of").write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")

    def start(self, stream: DataFrame, **trigger: object) -> StreamingQuery:
        """Run on a streaming DataFrame; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def counts(self) -> DataFrame:
        """(period, reason, n, batch): the dangling references after each batch."""
        return self.spark.read.parquet(f"{self.folder}/counts")
