from lodeplan.sources.tables import cut, read_csv, scratch, shared_dir, spread, table, write_csv


def test_cut_keeps_rows_and_schema_in_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) note", "array(id) ids").filter("id > 3")
    kept = cut(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(shared_dir(spark).removeprefix("file://") in f for f in kept.inputFiles())
    assert cut(df.limit(0)).count() == 0


def test_spread_only_widens(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    for n, widened in ((1, True), (cores, False)):
        spark.range(100).repartition(n).write.parquet(str(tmp_path / str(n)))
        read = spark.read.parquet(str(tmp_path / str(n)))
        assert ("RoundRobin" in spread(read)._jdf.queryExecution().executedPlan().toString()) == widened
        assert spread(read).count() == 100


def test_columns_are_pruned_and_filters_pushed(spark, data):
    plan = table(spark, data, "commerce_orders", "tenant_id", "order_id").filter("order_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tenant_id:string,order_id:bigint>" in plan and "GreaterThan(order_id,5)" in plan


def test_csv_round_trip(spark):
    rows = [(1, "", None), (2, None, " two  spaces "), (3, 'a "quoted", text', "back\\slash"), (4, "two\nlines", ""), (5, "ünï — ✓", "1e3"), (5, "ünï — ✓", "1e3")]
    df = spark.createDataFrame(rows, "n int, a string, b string").selectExpr("*", "timestamp_micros(n + 1700000000000000L) at", "cast(n / 3 as decimal(9, 4)) d", "if(n = 1, null, n > 2) flag")
    for kept, line_breaks in ((df, True), (df.filter("n <> 4"), False), (df.limit(0), False)):
        path = scratch(spark, "csv")
        write_csv(kept, path)
        assert sorted(map(str, read_csv(spark, path, df.schema, line_breaks=line_breaks).collect())) == sorted(map(str, kept.collect()))
