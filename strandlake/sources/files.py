"""Files of any size, read in byte ranges: no file is ever one row."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range that one task reads at a time; a multiple of the chunk size.
SPLIT = 64 << 20

LISTED = "uri string, name string, inode bigint, filetype int, filesize bigint, mtime timestamp"


def _kind(name: str) -> int | None:
    name = name.lower().removesuffix(".gz")
    return 200 if name.endswith((".fq", ".fastq")) else 100 if name.endswith((".fa", ".fna", ".fasta")) else None


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """uri, name, inode, filetype, filesize, mtime of all files, empty ones too, under one or several paths; a file under two of them once.

    The name is the path below the given folder, or a given file's base name. The inode is the file system's where it has one, else a
    number made of the uri. Only file statuses are on the driver; contents are read by tasks.
    """
    import datetime
    import os
    from urllib.parse import unquote, urlparse

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows: dict[str, tuple] = {}
    for given in [paths] if isinstance(paths, str) else paths:
        root = jvm.org.apache.hadoop.fs.Path(given)
        fs = root.getFileSystem(conf)
        base = fs.makeQualified(root).toUri().toString().rstrip("/")
        found = fs.listFiles(root, True)
        while found.hasNext():
            status = found.next()
            uri = status.getPath().toUri().toString()
            name = unquote(uri[len(base) :].lstrip("/") or uri.rsplit("/", 1)[1])
            local = unquote(urlparse(uri).path)
            inode = os.stat(local).st_ino if uri.startswith("file:") and os.path.exists(local) else zlib.crc32(uri.encode())
            when = datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.timezone.utc)
            rows.setdefault(uri, (uri, name, inode, _kind(name), status.getLen(), when))
    return spark.createDataFrame(list(rows.values()), LISTED)


def splits(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """The rows of files (uri, filesize) once for each range of ``size`` bytes, with its start and take; empty files have no range."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("filesize") - 1, F.lit(size).cast("bigint"))
    each = files.where("filesize > 0").withColumn("start", F.explode(starts))
    each = each.withColumn("take", F.least(F.lit(size).cast("bigint"), F.col("filesize") - F.col("start")))
    return each.repartition(F.col("uri"), F.col("start"))


def _opened(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def file_md5(files: DataFrame) -> DataFrame:
    """uri, md5 of whole files: a digest goes through a file in order, so a file is one task's stream, a buffer at a time."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                digest = hashlib.md5()
                with _opened(uri) as f:
                    while data := f.read(4 << 20):
                        digest.update(data)
                yield pa.RecordBatch.from_pydict({"uri": [uri], "md5": [digest.hexdigest()]})

    return files.select("uri").repartition("uri").mapInArrow(run, "uri string, md5 string")


def file_chunks(files: DataFrame, chunk: int, size: int = SPLIT) -> DataFrame:
    """uri, file_offset, chunk_size, sha, data of the chunks of ``chunk`` bytes of files; each range is cut by a task, some chunks at a time."""
    import hashlib

    if size % chunk:
        raise ValueError("size must be a multiple of chunk")
    some = max(1, (8 << 20) // chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, take in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "take"))):
                with _opened(uri) as f:
                    f.seek(start)
                    at, end = start, start + take
                    while at < end:
                        data = f.read(min(some * chunk, end - at))
                        pieces = [data[k : k + chunk] for k in range(0, len(data), chunk)]
                        if not pieces:
                            raise OSError(f"{uri} is shorter than it was")
                        yield pa.RecordBatch.from_arrays([
                            pa.array([uri] * len(pieces)), pa.array([at + k * chunk for k in range(len(pieces))], pa.int64()), pa.array([len(p) for p in pieces], pa.int32()),
                            pa.array([hashlib.sha1(p).hexdigest() for p in pieces]), pa.array(pieces, pa.binary()),
                        ], names=["uri", "file_offset", "chunk_size", "sha", "data"])
                        at += len(data)

    return splits(files, size).select("uri", "start", "take").mapInArrow(run, "uri string, file_offset bigint, chunk_size int, sha string, data binary")


def fastq_file_records(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """uri, rec_no, sb_id, title, seq, plus, qual: the four-line records of files (uri, filesize), numbered through each file, with their super-blocks.

    A first pass counts the newlines of each range; sums of these tell each range its first line's number, and it yields the records
    that begin in it, reading beyond its end where the last one does. Carriage returns at line ends are dropped; a file cut off
    in a record gives nulls for what is missing. Nothing is shuffled but a row per range.
    """
    from pyspark.sql import Window as W

    from strandlake.sources.fastx import SUPER_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, take in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "take"))):
                n, left = 0, take
                with _opened(uri) as f:
                    f.seek(start)
                    while left and (data := f.read(min(left, 4 << 20))):
                        n, left = n + data.count(b"\n"), left - len(data)
                yield pa.RecordBatch.from_pydict({"uri": [uri], "start": [start], "take": [take], "newlines": [n]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uri", "rec_no", "sb_id", "title", "seq", "plus", "qual"]

        def made(uri: str, first: int, lines: list[bytes]) -> pa.RecordBatch:
            lines = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
            rows = [lines[k : k + 4] + [None] * (4 - len(lines[k : k + 4])) for k in range(0, len(lines), 4)]
            no = range(first, first + len(rows))
            return pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), pa.array(no, pa.int64()), pa.array([k // SUPER_BLOCK for k in no], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], names=names)

        for b in batches:
            for uri, start, take, before in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "take", "before"))):
                with _opened(uri) as f:
                    # a line that begins at the very start of the range follows a newline just before it
                    at, number = start, before
                    f.seek(max(0, start - 1))
                    rest = f.read(1) if start else b"\n"
                    if rest != b"\n":
                        number += 1  # the line under way is the range's before
                        while (data := f.read(1 << 20)) and (k := data.find(b"\n")) < 0:
                            at += len(data)
                        at = at + k + 1 if data else start + take
                    # lines before the first whole record
                    buffer, lines, skip, end = b"", [], -number % 4, start + take
                    f.seek(at)
                    done = at >= end
                    while not done:
                        data = f.read(1 << 20)
                        buffer += data
                        pieces = buffer.split(b"\n")
                        buffer = pieces.pop() if data else b""
                        if not data and pieces and pieces[-1] == b"":
                            pieces.pop()  # what follows a last newline is no line
                        for line in pieces:
                            if skip:
                                skip, number = skip - 1, number + 1
                            elif at >= end and number % 4 == 0:
                                done = True
                                break
                            else:
                                lines.append(line)
                                number += 1
                            at += len(line) + 1
                        done = done or not data
                        whole = len(lines) - len(lines) % 4 if not done else len(lines)
                        if whole:
                            yield made(uri, (number - len(lines)) // 4, lines[:whole])
                            lines = lines[whole:]

    each = splits(files, size).select("uri", "start", "take")
    counts = each.mapInArrow(count, "uri string, start bigint, take bigint, newlines bigint")
    before = F.coalesce(F.sum("newlines").over(W.partitionBy("uri").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.select("uri", "start", "take", before.alias("before")).repartition("uri", "start")
    return numbered.mapInArrow(cut, "uri string, rec_no bigint, sb_id bigint, title string, seq string, plus string, qual string")
