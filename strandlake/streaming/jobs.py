"""Request streams, file sessions, idle flushes and usage windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from strandlake.runtime import shared_path

IDLE_SECONDS = 5


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A table's Parquet files (one file, or a folder of them) as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    path = f"{folder}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def usage_windows(events: DataFrame, ts: str, group: str, width: str = "300 seconds", late: str | None = None, amount: str | None = None) -> DataFrame:
    """group, window_start, n per tumbling window, with ``amount`` also its sum, used; with ``late``, a watermark drops what comes later than that."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width)
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum(amount).alias("used")] if amount else [])]
    return rows.groupBy(group, w.alias("w")).agg(*sums).select(group, F.col("w.start").alias("window_start"), "n", *(["used"] if amount else []))


def idle_sessions(events: DataFrame, ts: str, key: str, gap: str = f"{IDLE_SECONDS} seconds", late: str | None = None) -> DataFrame:
    """key, session_start, session_end (last event), n: runs of events with ``gap`` or less between them; a session is flushed when it has been idle for longer. Null keys are one key."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end")).select(key, F.col("w.start").alias("session_start"), "session_end", "n")


def route(requests: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], op: str = "op", checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch's rows go to their operation's handler, in the order of ``handlers``; rows of other operations are left. Handlers get the
    batch number and must be repeatable, as a batch may come again after a failure."""
    checkpoint = checkpoint or shared_path(requests.sparkSession, "requests")

    def each(batch: DataFrame, number: int) -> None:
        for name, handle in handlers.items():
            handle(batch.where(F.col(op) == name), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CatalogSink:
    """A catalog kept by requests in a stream: handlers for ``route`` that may run again for the same batch, and what the catalog then is.

    Each handler writes a batch's rows into a folder named by the operation and the batch's number, replacing what is there, so a batch that
    comes again after a failure changes nothing. The state of a key is its row of the last batch, and in a batch of the last ``order``.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str]):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order

    def _handler(self, gone: bool) -> Callable[[DataFrame, int], None]:
        def handle(batch: DataFrame, number: int) -> None:
            rows = batch.withColumn("__gone", F.lit(gone))
            rows.write.mode("overwrite").parquet(f"{self.root}/batch={number}/op={'delete' if gone else 'write'}")

        return handle

    def handlers(self, write: str = "write", delete: str = "delete") -> dict[str, Callable[[DataFrame, int], None]]:
        return {write: self._handler(False), delete: self._handler(True)}

    def current(self, schema: StructType) -> DataFrame:
        """Rows of the keys that are there, with the columns of ``schema``; of equal orders a delete is last."""
        from strandlake.operators.catalog import latest

        rows = self.spark.read.schema(StructType([*schema.fields, StructField("__gone", BooleanType()), StructField("batch", LongType()), StructField("op", StringType())])).parquet(self.root)
        return latest(rows, [self.key], ["batch", *self.order, "__gone"]).where("not __gone").select(*schema.fieldNames())


SESSION = "file_key string, parts bigint, bytes bigint, finished boolean"
_STATE = "parts bigint, bytes bigint"


def file_sessions(requests: DataFrame, idle_ms: int | None = IDLE_SECONDS * 1000) -> DataFrame:
    """file_key, parts, bytes, finished: a file's data requests (file_key, size, finish) add up; a row comes out when its finish request
    arrives, or, not finished, when nothing has come for idle_ms. State is two numbers a file.

    With idle_ms the query goes on by itself to look for idle files, so it is to be run with a processing-time trigger and stopped; with
    None there is no flush, and it can be run over what is there now."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, size = state.get if state.exists else (0, 0)
        row = lambda done: pd.DataFrame({"file_key": [key[0]], "parts": [parts], "bytes": [size], "finished": [done]})
        if state.hasTimedOut:
            state.remove()
            yield row(False)
            return
        end = False
        for b in batches:
            data = b[~b["finish"]]
            parts, size, end = parts + len(data), size + int(data["size"].fillna(0).sum()), end or bool(b["finish"].any())
        if end:
            if state.exists:
                state.remove()
            yield row(True)
        else:
            state.update((parts, size))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)

    return requests.groupBy("file_key").applyInPandasWithState(step, SESSION, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def to_table(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a Parquet table on shared storage, with its checkpoint beside it, and read that."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, what)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", path + ".checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
