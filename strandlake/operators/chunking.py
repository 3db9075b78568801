"""Cutting byte objects into chunks with fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_chunks(objects: DataFrame, key: str, data: Column, size: int) -> DataFrame:
    """key, file_offset, chunk_size, sha of consecutive chunks of ``size`` bytes; the last is shorter. Null and empty objects have none."""
    rows = objects.select(F.col(key), data.cast("binary").alias("__data")).where(F.octet_length("__data") > 0)
    starts = F.sequence(F.lit(0), F.expr(f"(octet_length(__data) - 1) div {size}").cast("int"))

    def piece(k: Column) -> Column:
        part = F.substring(F.col("__data"), k * size + 1, F.lit(size))
        return F.struct((k.cast("bigint") * size).alias("file_offset"), F.octet_length(part).alias("chunk_size"), F.sha1(part).alias("sha"))

    # pieces are made before they become rows, so that no row carries its whole object
    return rows.select(key, F.explode(F.transform(starts, piece)).alias("x")).select(key, "x.file_offset", "x.chunk_size", "x.sha")


def _window_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the up to 8 bytes from each offset, ended by a NUL: shift by four, add, fold the top nibble."""
    h, live = np.zeros(len(b), np.uint64), np.ones(len(b), bool)
    p = np.r_[b, np.zeros(8, np.uint8)].astype(np.uint64)
    for k in range(8):
        c = p[k : k + len(b)]
        live &= c != 0
        n = (h << np.uint64(4)) + c
        x = n & np.uint64(0xF0000000)
        n = (n ^ (x >> np.uint64(24))) & ~x
        h = np.where(live, n, h)
    return h


def content_cuts(data: bytes, size: int = 8192, divisor: int = 256, residue: int = 255) -> list[int]:
    """Ends of content-defined chunks. From a chunk's start the object is walked in steps of 8 bytes; it is cut after a window whose hash
    has the residue, once a quarter of ``size`` is reached, and at four times ``size`` at the latest. A rest up to the quarter is one chunk."""
    low, high, n, at, cuts = size // 4, size * 4, len(data), 0, []
    hit = _window_hashes(np.frombuffer(data, np.uint8)) % divisor == residue
    while at < n:
        if n - at <= low:
            cuts.append(n)
            break
        first = -(-max(low - 8, 0) // 8) * 8  # the first window that ends at or after the least size
        stop = min(n, at + high)
        places = np.flatnonzero(hit[at + first : stop : 8])
        end = min(at + first + 8 * int(places[0]) + 8, stop) if len(places) else stop
        cuts.append(end)
        at = end
    return cuts


def content_chunks(objects: DataFrame, key: str, data: Column, size: int = 8192) -> DataFrame:
    """key, file_offset, chunk_size, sha of content-defined chunks (content_cuts). Each object is cut by itself; null and empty ones have no chunks."""
    import hashlib

    kind = objects.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offsets, sizes, shas = [], [], [], []
            for k, d in enumerate(b.column("data").to_pylist()):
                at = 0
                for end in content_cuts(d, size):
                    rows.append(k)
                    offsets.append(at)
                    sizes.append(end - at)
                    shas.append(hashlib.sha1(d[at:end]).hexdigest())
                    at = end
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(shas, pa.string())], names=[key, "file_offset", "chunk_size", "sha"])

    rows = objects.select(F.col(key).alias("key"), data.cast("binary").alias("data")).where(F.octet_length("data") > 0)
    return rows.mapInArrow(run, f"`{key}` {kind}, file_offset bigint, chunk_size int, sha string")
