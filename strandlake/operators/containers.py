"""Containers as data: chunks packed, written, cut out again, and numbers given out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import dedup


def write(chunks: DataFrame, stream: str, sha: str, data: str, capacity: int, path: str) -> str:
    """Pack the chunks of each stream (a non-negative int) by fingerprint into containers, and write these and their fingerprints under ``path``, which is returned.

    ``data``: container_id and payload, a row a container (bounded by the capacity, or one larger chunk), in two folders by the number's last
    bit. ``fps``: container_id, sha, container_offset, size. A container's number is its stream and its place in it. Null and empty chunks
    and null streams are left out.
    """
    rows = chunks.where(F.col(stream).isNotNull() & (F.octet_length(data) > 0)).select(F.col(stream).cast("bigint").alias("stream"), F.col(sha).alias("sha"), F.octet_length(data).alias("size"), F.col(data).alias("data"))
    boxed = dedup.packed(rows, "stream", ["sha"], "size", capacity).withColumn("container_id", F.shiftleft("stream", 32) + F.col("box_no"))
    parts = F.array_sort(F.collect_list(F.struct("sha", "size", "data")))
    one = boxed.groupBy("container_id").agg(parts.alias("x"))
    payload = F.unhex(F.array_join(F.transform("x", lambda p: F.hex(p["data"])), ""))
    one.select("container_id", payload.alias("payload"), F.pmod("container_id", F.lit(2)).alias("side")).write.partitionBy("side").parquet(f"{path}/data")
    each = boxed.select("container_id", "sha", "size")
    before = F.sum("size").over(dedup.W.partitionBy("container_id").orderBy("sha").rowsBetween(dedup.W.unboundedPreceding, -1))
    each.select("container_id", "sha", F.coalesce(before, F.lit(0)).cast("int").alias("container_offset"), "size").write.parquet(f"{path}/fps")
    return path


def slices(path: str, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
    """container_id, sha, data of the chunks of written containers, or of those with the fingerprints of ``wanted`` (sha): only their containers are opened."""
    fps, boxes = spark.read.parquet(f"{path}/fps"), spark.read.parquet(f"{path}/data")
    if wanted is not None:
        fps = fps.join(wanted.select("sha").distinct(), "sha", "left_semi")
    met = boxes.select("container_id", "payload").join(fps, "container_id")
    return met.select("container_id", "sha", F.expr("substring(payload, container_offset + 1, size)").alias("data"))


def recyclable(containers: DataFrame, now, delay: int = 5) -> DataFrame:
    """container_id, generation of numbers that may be given out again: no row of theirs is live, and the last delete is more than ``delay`` seconds before ``now``; generation is the next one."""
    last = containers.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.max("deleted_at").alias("gone"), F.max("generation").alias("g"))
    return last.where((F.col("live") == 0) & (F.col("gone") < now - F.expr(f"interval {delay} seconds"))).select("container_id", (F.col("g") + 1).alias("generation"))
