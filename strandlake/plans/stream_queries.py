"""Windows, sessions and request streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.plans.tables import table
from strandlake.runtime import shared_path, written
from strandlake.streaming import jobs


def usage_windows(s, d):
    return jobs.usage_windows(table(s, d, "events"), "ts", "event_type", "1 hour").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


def idle_sessions(s, d):
    out = jobs.idle_sessions(table(s, d, "events"), "ts", "user_id", "1 hour")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n")


def stream_event_counts(s, d):
    """Counts per event type from a stream over all that is there now; no windows, as open ones would not be written."""
    rows = jobs.table_stream(s, d, "events", table(s, d, "events").schema)
    by = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    path = shared_path(s, "usage")
    got: list = []

    def keep(batch, number):  # complete mode: the last batch has all
        got[:] = [written(batch, f"usage-{number}")]

    q = by.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return got[0] if got else by.sparkSession.createDataFrame([], by.schema)


def container_usage(s, d):
    """Bytes and chunks that each uploads' batch brought in a minute."""
    rows = table(s, d, "chunks").dropDuplicates(["chunk_id"]).where("received_at is not null")
    out = jobs.usage_windows(rows, "received_at", "batch_no", "60 seconds", amount="chunk_size")
    return out.select("batch_no", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "n", "used")


def stream_catalog(s, d):
    """The catalog after its registrations have come as a stream of write and delete requests."""
    files = table(s, d, "files")
    asked = jobs.table_stream(s, d, "files", files.schema).where("file_key is not null").withColumn("op", F.when(F.col("deleted_at").isNull(), "write").otherwise("delete"))
    sink = jobs.CatalogSink(s, shared_path(s, "catalog"), "file_key", ["registered_at", "file_id"])
    jobs.route(asked, sink.handlers()).awaitTermination()
    return sink.current(files.schema).select("file_key", "file_id", "compressor_id")


def file_sessions(s, d):
    """Uploads as files whose parts come as requests, the last one followed by a finish; from a stream with state."""
    chunks = table(s, d, "chunks")
    parts = jobs.table_stream(s, d, "chunks", chunks.schema)
    sent = parts.select(F.col("upload_id").cast("string").alias("file_key"), F.col("chunk_size").cast("bigint").alias("size"), F.explode(F.array(F.lit(False), F.lit(True))).alias("finish"))
    # a file of the table comes whole in one batch, so its finish requests are with its parts
    return jobs.to_table(jobs.file_sessions(sent, None), "sessions").groupBy("file_key").agg(F.sum("parts").alias("parts"), F.sum("bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (usage_windows, idle_sessions, stream_event_counts, file_sessions, container_usage, stream_catalog)}
SQL = {
    "usage_windows": "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, count(*) as n from events group by 1, 2",
    "idle_sessions": """with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 1 hour, true)::int as st from events),
        r as (select *, sum(st) over (partition by user_id order by ts rows unbounded preceding) as k from e)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n from r group by user_id, k""",
    "container_usage": """select batch_no, strftime(date_trunc('minute', received_at), '%Y-%m-%d %H:%M') as minute, count(*) as n, sum(chunk_size)::bigint as used
        from (select distinct chunk_id, batch_no, received_at, chunk_size from chunks where received_at is not null) group by 1, 2""",
    "stream_catalog": """select file_key, file_id, compressor_id from (select * from (select distinct * from files) where file_key is not null
        qualify row_number() over (partition by file_key order by registered_at desc nulls last, file_id desc) = 1) where deleted_at is null""",
    "stream_event_counts": "select event_type, count(*) as n from events group by 1",
    "file_sessions": "select upload_id::varchar as file_key, count(*) as parts, sum(coalesce(chunk_size, 0))::bigint as bytes from chunks group by 1",
}
