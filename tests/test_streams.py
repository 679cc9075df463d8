from lodestone.streaming import streams


def source(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_job_machine(spark, tmp_path):
    events = [[(1, "queued", 1), (1, "running", 2), (2, "running", 1)], [(1, "succeeded", 3), (1, "running", 4), (2, "queued", 2), (2, "cancelled", 3)]]
    schema = "job long, state string, seq long"
    rows = streams.run(spark, streams.job_machine(source(spark, tmp_path / "in", [sum(events, [])], schema)), "update").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "succeeded", 1), (2, "cancelled", 1)]


def test_newest_only_and_backfill(spark, tmp_path):
    schema = "job long, seq long, done long"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5)], schema).write.parquet(str(tmp_path / "in"))
    streams.newest_only(stream(), "job", "seq", str(tmp_path / "out")).awaitTermination()
    streams.backfill(stream(), str(tmp_path / "back")).awaitTermination()
    spark.createDataFrame([(1, 3, 30)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    streams.newest_only(stream(), "job", "seq", str(tmp_path / "out")).awaitTermination()
    streams.backfill(stream(), str(tmp_path / "back")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "1")).select("job", "done").collect()) == [(1, 30), (2, 5)]
    assert spark.read.parquet(str(tmp_path / "back" / "rows")).count() == 4


def test_stage_times(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [[(1, "parse", 5), (1, "parse", 9), (1, "index", 9)]], "run long, stage string, ts long")
    assert sorted(tuple(r) for r in streams.run(spark, streams.stage_times(stream), "complete").collect()) == [(1, "index", 9, 9), (1, "parse", 5, 9)]


def test_distinct_within_and_an_empty_source(spark, tmp_path):
    schema = "user_id long, event_type string, ts timestamp"
    rows = spark.sql("SELECT 1L AS user_id, 'a' AS event_type, TIMESTAMP '2024-01-01 00:00:00' AS ts UNION ALL SELECT 1L, 'a', TIMESTAMP '2024-01-01 00:05:00'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert streams.run(spark, streams.distinct_requests(stream, within="1 hour"), "append").count() == 1
    (tmp_path / "none").mkdir()
    assert streams.run(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "none")), "append").count() == 0
