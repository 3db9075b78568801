"""Placement keys and string hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_of_md5(md5: Column | str, nodes: int) -> Column:
    """Node 1 to n from the character codes of a digest's first two hex digits."""
    return (F.pmod(F.ascii(_c(md5)) * 256 + F.ascii(F.substring(_c(md5), 2, 1)), F.lit(nodes)) + 1).cast("int")


def leading_bits(sha: Column | str, bits: int) -> Column:
    """The first bits (at most 32) of a hex digest, as a number."""
    digits = -(-bits // 4)
    return F.shiftright(F.conv(F.substring(_c(sha), 1, digits), 16, 10).cast("bigint"), 4 * digits - bits)


def node_of_sha(sha: Column | str, nodes: int) -> Column:
    """Node 0 to n - 1 from a digest's first byte."""
    return F.pmod(leading_bits(sha, 8), F.lit(nodes)).cast("int")


def cache_bucket(sha: Column | str, bits: int = 12) -> Column:
    return leading_bits(sha, bits).cast("int")


def low_key(data: Column) -> Column:
    """The last 16 bits of the SHA-1 of some bytes."""
    return F.conv(F.right(F.sha1(data), F.lit(4)), 16, 10).cast("int")


U = np.uint64
_TOP = U(0x7FFFFFFFFFFFFFFF)


def _apply(step, start: int, data: list[bytes]) -> np.ndarray:
    """step(hash, byte, place) for all strings side by side, up to each one's end or first NUL."""
    data = [d.split(b"\0", 1)[0] for d in data]
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat, at = np.frombuffer(b"".join(data), np.uint8).astype(U), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    h = np.full(len(data), start, U)
    order = np.argsort(-size, kind="stable")
    for k in range(int(size.max()) if len(size) else 0):
        live = order[: np.searchsorted(-size[order], -k, "left")]
        h[live] = step(h[live], flat[at[live] + k], k)
    return h & _TOP


def _pjw(h, c, k):
    h = (h << U(8)) + c
    high = h & U(0xFF00000000000000)
    return np.where(high != 0, (h ^ (high >> U(48))) & U(0x00FFFFFFFFFFFFFF), h)


def _elf(h, c, k):
    h = (h << U(4)) + c
    x = h & U(0xF0000000)
    return (h ^ (x >> U(24))) & ~x


def _rs(h, c, k):
    return h * U(63689 * pow(378551, k, 1 << 64) % (1 << 64)) + c


def _ap(h, c, k):
    return h ^ ((h << U(7)) ^ c ^ (h >> U(3))) if k % 2 == 0 else h ^ ~((h << U(11)) ^ c ^ (h >> U(5)))


#: name -> start value and step. Fixed values of the published hash functions.
FAMILY = {
    "simple": (0, lambda h, c, k: h * U(1023) + c),
    "rs": (0, _rs),
    "js": (1315423911, lambda h, c, k: h ^ ((h << U(5)) + c + (h >> U(2)))),
    "pjw": (0, _pjw),
    "elf": (0, _elf),
    "bkdr": (0, lambda h, c, k: h * U(131) + c),
    "sdbm": (0, lambda h, c, k: c + (h << U(6)) + (h << U(16)) - h),
    "djb": (5381, lambda h, c, k: h + (h << U(5)) + c),
    "ap": (0, _ap),
}


def words_checksum(data: bytes) -> int:
    """Complement of the folded sum of little-endian 16-bit words, up to the first NUL."""
    data = data.split(b"\0", 1)[0]
    total = int(np.frombuffer(data + b"\0" * (len(data) % 2), "<u2").sum(dtype=np.uint64))
    total = (total >> 32) + (total & 0xFFFFFFFF)
    total += total >> 16
    return ~total & 0xFFFF


def rolling_sum(data: bytes, offset: int = 0) -> int:
    """Two running 16-bit sums of the bytes and of their prefix sums: (second << 16) + first, in 32 bits."""
    b = np.frombuffer(data, np.uint8).astype(np.int64) + offset
    one, two = int(b.sum()), int((b * np.arange(len(b), 0, -1)).sum())
    return ((one & 0xFFFF) + (two << 16)) & 0xFFFFFFFF


def roll(value: int, size: int, out: int, new: int, offset: int = 0) -> int:
    """rolling_sum after the window of ``size`` bytes moves by one: byte ``out`` leaves, ``new`` comes."""
    one, two = value & 0xFFFF, value >> 16
    one = one - out + new
    two = two - size * (out + offset) + one
    return ((one & 0xFFFF) + (two << 16)) & 0xFFFFFFFF


def rabin(data: bytes, poly: int = 1) -> int:
    """Residue of the bytes, read as a polynomial over GF(2), modulo x^32 + poly, in four-byte steps; up to the first NUL."""
    data = data.split(b"\0", 1)[0]
    power = [poly]
    for _ in range(31):
        power.append(((power[-1] << 1) & 0xFFFFFFFF) ^ (poly if power[-1] >> 31 else 0))

    def shifted(w: int) -> int:
        out = 0
        for k in range(32):
            if w >> k & 1:
                out ^= power[k]
        return out

    lead = len(data) % 4
    w = int.from_bytes(data[:lead], "big")
    for k in range(lead, len(data), 4):
        w = shifted(w) ^ int.from_bytes(data[k : k + 4], "big")
    return w


def string_hash(text: Column | str, name: str) -> Column:
    """A 63-bit hash of a string's bytes by name: one of FAMILY, crc, rabin or rolling. Null stays null."""
    if name in FAMILY:
        start, step = FAMILY[name]
        run = lambda data: _apply(step, start, data)
    else:
        one = {"crc": words_checksum, "rabin": rabin, "rolling": rolling_sum}[name]
        run = lambda data: np.array([one(d) for d in data], U)

    @F.pandas_udf("bigint")
    def udf(s: pd.Series) -> pd.Series:
        ok = s.notna().to_numpy()
        out = pd.Series([None] * len(s), dtype="Int64")
        if ok.any():
            out[ok] = run([x.encode() for x in s[ok]]).view(np.int64)
        return out

    return udf(_c(text))
