"""Membership filters as tables of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 6
#: Bits per key at least, for which about one unknown key in a thousand is affirmed; and the least size of a filter.
BITS_PER_KEY, LEAST = 16, 1 << 16


def size_for(keys: int) -> int:
    """Bits of a filter for so many distinct keys: the least power of two with BITS_PER_KEY for each, LEAST at least."""
    return max(LEAST, 1 << max(0, keys * BITS_PER_KEY - 1).bit_length())


def slots(fp: Column | str, size: int) -> Column:
    """The HASHES slots of a 40-digit fingerprint: six hex digits each, modulo the filter's size; above 2^24, with 24 higher bits of a digest."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    digits = [F.conv(F.substring(fp, 1 + 6 * i, 6), 16, 10).cast("bigint") for i in range(HASHES)]
    if size > 1 << 24:
        digits = [n + F.shiftleft(F.pmod(F.xxhash64(F.lit(i), fp), F.lit(1 << 24)), 24) for i, n in enumerate(digits)]
    return F.array_distinct(F.array(*(F.pmod(n, F.lit(size)) for n in digits)))


def bloom(keys: DataFrame, fp: str, size: int) -> DataFrame:
    """slot: the set bits of a filter of ``size`` bits, at most ``size`` rows whatever the number of keys."""
    return keys.where(F.col(fp).isNotNull()).select(F.explode(slots(fp, size)).alias("slot")).distinct()


def bloom_words(bits: DataFrame) -> DataFrame:
    """bucket, bitmap: the set bits as bitmaps of 32,768 each."""
    return bits.groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bitmap"))


def probe(keys: DataFrame, fp: str, filled: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """Distinct keys (with ``by`` of the filter: per filter) all of whose slots are set: possibly members; keys that are not here are not."""
    by = by or []
    ask = keys.where(F.col(fp).isNotNull()).select(fp).distinct().select(fp, F.size(slots(fp, size)).alias("need"), F.explode(slots(fp, size)).alias("slot"))
    met = ask.join(filled, "slot").groupBy(*by, fp).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return met.where("n = need").select(*by, fp)


def counting(changes: DataFrame, fp: str, n: str, size: int, by: list[str] | None = None) -> DataFrame:
    """by, slot, cnt of a counting filter: the sum of the changes (additions positive, removals negative) of each slot, where it is above 0."""
    by = by or []
    return changes.where(F.col(fp).isNotNull()).select(*by, n, F.explode(slots(fp, size)).alias("slot")).groupBy(*by, "slot").agg(F.sum(n).alias("cnt")).where("cnt > 0")
