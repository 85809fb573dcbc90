from pyspark.sql import functions as F

from lodeplan.streaming.orphans import OrphanStream
from tests.test_references import CHILD, KEY, expected, feed


def test_stream_equals_a_full_pass_and_repeats_safely(spark, tmp_path):
    parents, children = feed(4, 120)
    p = spark.createDataFrame(parents, "row long, t string, k long, at timestamp, op string").withColumn("line", F.lit(None).cast("int")).withColumn("kind", F.lit("parent"))
    c = spark.createDataFrame(children, "t string, k long, line int, at timestamp").selectExpr("cast(null as bigint) row", "t", "k", "at", "cast(null as string) op", "line", "'reference' kind")
    rows = p.unionByName(c).orderBy("at").repartitionByRange(4, "at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracked = OrphanStream(spark, str(tmp_path / "out"), key=KEY, child=CHILD, at="at", row="row", is_parent=F.col("kind") == "parent", gone=F.col("op") == "delete")
    query = tracked.start(stream, availableNow=True)
    query.awaitTermination()
    last = max(r.batch for r in tracked.counts().select("batch").distinct().collect())
    assert last >= 2
    found = lambda: {(r.k, r.line, r.reason) for r in tracked.state(last).report().collect()}
    want = {x[:3] for x in expected(parents, children)}
    assert found() == want
    files = spark.read.schema(rows.schema).parquet(str(tmp_path / "in"))
    # A batch that is processed twice leaves the state as after once.
    tracked.process(files, 0)
    once = {(r.k, r.line, r.reason) for r in tracked.state(0).report().collect()}
    tracked.process(files, 0)
    assert {(r.k, r.line, r.reason) for r in tracked.state(0).report().collect()} == once == want
