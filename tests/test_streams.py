from pyspark.sql import functions as F

from strandlake.streaming import jobs


def test_requests_are_routed(spark, tmp_path):
    spark.createDataFrame([("write", 1), ("read", 2), ("write", 3), ("odd", 4), (None, 5)], "op string, x int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("op string, x int").parquet(str(tmp_path / "in"))
    seen = {"write": [], "read": []}
    q = jobs.route(stream, {n: (lambda df, _, n=n: seen[n].extend(r["x"] for r in df.collect())) for n in seen}, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {k: sorted(v) for k, v in seen.items()} == {"write": [1, 3], "read": [2]}


def test_sessions_end_with_finish(spark, tmp_path):
    rows = [("a", 5, False), ("a", None, False), ("a", 0, True), ("b", 7, False)]
    spark.createDataFrame(rows, "file_key string, size bigint, finish boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_key string, size bigint, finish boolean").parquet(str(tmp_path / "in"))
    got = jobs.to_table(jobs.file_sessions(stream, None), "sessions").collect()
    assert [tuple(r) for r in got] == [("a", 2, 5, True)]


def test_sessions_split_beyond_the_gap(spark):
    df = spark.createDataFrame([("k", 0), ("k", 4), ("k", 9), ("k", 15), (None, 1)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["n"] for r in jobs.idle_sessions(df, "ts", "k", "5 seconds").collect()) == [1, 1, 3]


def test_a_catalog_from_requests_that_come_again(spark, tmp_path):
    sink = jobs.CatalogSink(spark, str(tmp_path / "c"), "k", ["at"])
    schema = spark.createDataFrame([], "k string, at int, v int").schema
    rows = lambda x: spark.createDataFrame(x, schema)
    write, delete = sink.handlers().values()
    for _ in range(2):  # the first batch comes again after a failure
        write(rows([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("c", 5, 1)]), 0)
        delete(rows([("c", 5, None), ("z", 1, None)]), 0)
    write(rows([("c", 1, 7)]), 1)
    delete(rows([("b", 0, None)]), 1)
    assert sorted(map(tuple, sink.current(schema).collect())) == [("a", 2, 2), ("c", 1, 7)]


def test_sessions_over_batches_and_their_idle_flush(spark, tmp_path):
    """State is carried from batch to batch, and a file that nothing comes for is flushed as not finished."""
    import time

    at, schema = tmp_path / "in", "file_key string, size bigint, finish boolean"
    put = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(str(at))
    put([("a", 5, False), ("b", 7, False)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
    q = jobs.file_sessions(stream, 3000).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while not (q.lastProgress and any(p["numInputRows"] for p in q.recentProgress)) and time.time() < until:
            time.sleep(0.2)
        put([("a", 6, False), ("a", 0, True)])
        while spark.table("flushed").count() < 2 and time.time() < until:
            time.sleep(0.3)
        assert {tuple(r) for r in spark.table("flushed").collect()} == {("a", 2, 11, True), ("b", 1, 7, False)}
    finally:
        q.stop()
