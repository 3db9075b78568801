"""Columns of letter sequences as NumPy arrays, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _k


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; by sorting, which is many times faster here than np.unique's hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Letters:
    """The bytes of all sequences of a batch in a row, with a byte that is no letter between them."""

    def __init__(self, column: pa.Array):
        texts = [x.encode("utf-8", "replace") if x else b"" for x in column.to_pylist()]
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.r_[0, np.cumsum(size)[:-1]] if len(texts) else np.zeros(0, np.int64)
        self.code = _CODE[self.data]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 2-bit codes of the k letters (k <= 32) from each place, and whether these are all A, C, G or T."""
        n = max(0, len(self.code) - k + 1)
        out, bits, power, done = np.zeros(n, np.uint64), (self.code & 3).astype(np.uint64), 1, 0
        # by doubling: block has the code of the next `power` letters
        block, rest = bits, k
        while rest:
            if rest & 1:
                out = (out << np.uint64(2 * power)) | block[done : done + n]
                done += power
            rest >>= 1
            if rest:
                m = len(block) - power
                block = (block[:m] << np.uint64(2 * power)) | block[power : power + m]
                power *= 2
        bad = np.r_[0, np.cumsum(self.code > 3)]
        return out, bad[k : k + n] == bad[:n]

    def good_windows(self, w: int, min_letters: int) -> np.ndarray:
        """Whether the w letters from each place are all A, C, G or T, with at least min_letters different ones."""
        n = max(0, len(self.code) - w + 1)
        kinds = np.zeros(n, np.int8)
        for c in range(4):
            s = np.r_[0, np.cumsum(self.code == c)]
            kinds += s[w : w + n] > s[:n]
        bad = np.r_[0, np.cumsum(self.code > 3)]
        return (bad[w : w + n] == bad[:n]) & (kinds >= min_letters)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def runs_of(windows: DataFrame, width: int) -> DataFrame:
    """Maximal runs of letters covered by windows (rec_no, pos), each once, of the same width: rec_no, rec_offset, match_len."""
    by = W.partitionBy("rec_no").orderBy("pos")
    gap = F.col("pos") > F.lag("pos").over(by) + width
    starts = windows.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(by))
    out = starts.groupBy("rec_no", "run").agg(F.min("pos").cast("int").alias("rec_offset"), (F.max("pos") - F.min("pos") + width).cast("int").alias("match_len"))
    return out.select("rec_no", "rec_offset", "match_len")
