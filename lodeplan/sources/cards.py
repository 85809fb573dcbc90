"""Search cards on shared storage, one folder per snapshot."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplan.plans.errors import Reason, Refused


class CardIndex:
    """Cards of published snapshots.

    A snapshot is indexed once and read only when complete. Retiring one hides it by an entry in
    the list of retired snapshots; the files stay until storage is cleaned up.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def index(self, cards: DataFrame, snapshot_id: str) -> None:
        """Write the snapshot's cards; vectors, if there are any, must have one size."""
        own = cards.filter(F.col("snapshot_id") == snapshot_id)
        if "embedding" in own.columns:
            sizes = own.filter(F.col("embedding").isNotNull()).agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
            if sizes[0] != sizes[1]:
                raise Refused(Reason.UNSUPPORTED_CAPABILITY, f"vectors of {sizes[0]} to {sizes[1]} numbers")
        try:
            own.write.mode("error").parquet(f"{self.folder}/cards/{snapshot_id}")
        except AnalysisException:
            raise Refused(Reason.VALIDATION_FAILED, f"{snapshot_id} is indexed already") from None

    def _retired(self, snapshot_id: str) -> bool:
        try:
            return not self.spark.read.text(f"{self.folder}/retired").filter(F.col("value") == snapshot_id).isEmpty()
        except AnalysisException:
            return False

    def retire(self, snapshot_id: str) -> None:
        self.spark.createDataFrame([(snapshot_id,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/retired")

    def is_ready(self, snapshot_id: str, expected: int) -> bool:
        """Whether all expected cards can be searched."""
        try:
            return self.read(snapshot_id).count() == expected
        except Refused:
            return False

    def read(self, snapshot_id: str) -> DataFrame:
        if self._retired(snapshot_id):
            raise Refused(Reason.SNAPSHOT_NOT_READY, f"{snapshot_id} is retired")
        try:
            return self.spark.read.parquet(f"{self.folder}/cards/{snapshot_id}")
        except AnalysisException:
            raise Refused(Reason.SNAPSHOT_NOT_READY, f"{snapshot_id} isn't indexed") from None
