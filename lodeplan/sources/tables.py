"""Reading the project's Parquet tables and cutting lineage on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``, narrowed to ``columns`` if any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the one that the
    context was given for checkpoints.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster, whose
    executors would each write to their own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodeplan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _storage(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system that holds ``path``, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str = "cut") -> str:
    """A new path in the shared folder. All of an application's go when the application ends."""
    root = f"{shared_dir(spark)}/lodeplan-{spark.sparkContext.applicationId}"
    storage, where = _storage(spark, root)
    storage.mkdirs(where)
    storage.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if it is there."""
    storage, where = _storage(spark, path)
    storage.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: same rows, no lineage.

    A lost executor then costs a re-read, not a re-computation. Parquet is used rather than
    ``checkpoint()`` because it is compressed and keeps column statistics for pruning.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_range(df: DataFrame, parts: int, *columns: str) -> DataFrame:
    """``df`` in ``parts`` ranges of ``columns`` of about equal numbers of rows, numbered in ``slice``.

    Ranges are cut wherever the rows are many, within a key as well, so a hot key is spread over
    as many tasks as its share of the rows asks for. The cuts are sampled once and kept by the
    exchange: a task that is tried again gets the same rows.
    """
    return df.repartitionByRange(parts, *columns).withColumn("slice", F.spark_partition_id())


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, if it would come in fewer.

    For work that is heavy per row and would otherwise be bound to the few row groups of a small
    file. What is large by Spark's estimate, or lies in as many files as there are cores, is left
    as it is. Looks at statistics only; nothing runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    partition_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * partition_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as UTF-8 CSV files with headers, one per partition.

    A null is an empty field, an empty text is ``""``, quotes are doubled, spaces are kept, instants are ISO 8601
    to the microsecond with their offset. Columns must be flat. An existing path is an error.
    """
    df.write.csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: StructType, *, line_breaks: bool = False) -> DataFrame:
    """What :func:`write_csv` wrote. ``line_breaks``: whether texts hold any; files are then read as
    a whole, and ``\\r\\n`` within a text becomes ``\\n``. A text of one NUL character reads as null. A row
    that doesn't fit the schema is an error."""
    # Told from an empty text, an empty field is read as this and then as null.
    nothing = "\0"
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=line_breaks, nullValue=nothing, mode="FAILFAST", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
