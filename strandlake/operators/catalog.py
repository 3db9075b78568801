"""The catalog of stored files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.formatting import human_size, minute_time, padded, type_name


def listing(files: DataFrame) -> DataFrame:
    """name, size, type, mtime as text, for display; order by name where it is shown."""
    return files.select(F.col("file_key").alias("name"), human_size("filesize").alias("size"), type_name("filetype").alias("type"), minute_time("mtime").alias("mtime"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; nulls come first. By partial aggregation, in one shuffle."""
    marks = [c for o in order for c in (F.col(o).isNotNull(), F.col(o))]
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*(m.alias(f"o{i}") for i, m in enumerate(marks)))).alias("__r"))
    return last.select(*key, *(F.col(f"__r.{c}").alias(c) for c in others)).select(*rows.columns)


def merged(catalogs: list[DataFrame], key: str) -> DataFrame:
    """Union of catalogs; for a key in several the later catalog wins, and within one an arbitrary but fixed row."""
    tagged = reduce(DataFrame.unionByName, [c.withColumn("__n", F.lit(i)) for i, c in enumerate(catalogs)])
    return latest(tagged.withColumn("__h", F.xxhash64(*catalogs[0].columns)), [key], ["__n", "__h"]).drop("__n", "__h")


def lookup(files: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Each asked key with filetype, filesize, inode and ack 1, or zeros and ack 0."""
    have = files.select(key, "filetype", "filesize", "inode", F.lit(1).alias("ack"))
    out = asked.select(key).distinct().join(have, key, "left")
    return out.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("filetype", "filesize", "inode", "ack")))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def locations(segments: DataFrame) -> DataFrame:
    """md5, off_loc (offset -> path) of segments (md5, file_offset, path); of several paths of an offset the smallest."""
    one = segments.groupBy("md5", "file_offset").agg(F.min("path").alias("path"))
    return one.groupBy("md5").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_offset", "path")))).alias("off_loc"))


def segment(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """md5, file_offset, path, found of each asked (md5, file_offset): the path of ``segments``, the smallest of several, or null."""
    one = segments.groupBy("md5", "file_offset").agg(F.min("path").alias("path"))
    out = asked.select("md5", "file_offset").distinct().join(one, ["md5", "file_offset"], "left")
    return out.withColumn("found", F.col("path").isNotNull())


def output_path(root: str, n) -> F.Column:
    """root/000000/000000 for a running number: a thousand files a folder."""
    return F.concat(F.lit(root + "/"), padded(F.expr(f"{n} div 1000")), F.lit("/"), padded(F.expr(f"{n} % 1000")))
