"""Text forms of catalog values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FASTA, FASTQ = 100, 200


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_size(n: Column | str) -> Column:
    """Bytes below 1024 as ``nB``, else with one decimal in KB, MB or GB. Null stays null."""
    n = _c(n)
    kb = lambda p: n / float(1024**p)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024**2, F.format_string("%.1fKB", kb(1)))
        .when(n < 1024**3, F.format_string("%.1fMB", kb(2)))
        .when(n.isNotNull(), F.format_string("%.1fGB", kb(3)))
    )


def minute_time(t: Column | str) -> Column:
    """A timestamp as yyyy-MM-dd HH:mm in the session's zone (UTC)."""
    return F.date_format(_c(t), "yyyy-MM-dd HH:mm")


def type_name(code: Column | str) -> Column:
    """100 is fasta, 200 fastq, anything else (null too) unknown."""
    return F.when(_c(code) == FASTA, "fasta").when(_c(code) == FASTQ, "fastq").otherwise("unknown")


def basename(path: Column | str) -> Column:
    """What follows the last slash; null for paths without one."""
    return F.when(F.instr(_c(path), "/") > 0, F.regexp_extract(_c(path), r"([^/]*)$", 1))


def catalog_key(name: Column | str, client: Column | str, inode: Column | str) -> Column:
    """name_client_inode; null if any of them is."""
    return F.concat(_c(name), F.lit("_"), _c(client).cast("string"), F.lit("_"), _c(inode).cast("string"))


def map_name(inode: Column | str, client: Column | str, at: Column | str) -> Column:
    """inode_client_seconds of a chunk map; null if any of them is."""
    return F.concat(_c(inode).cast("string"), F.lit("_"), _c(client).cast("string"), F.lit("_"), F.unix_timestamp(_c(at)).cast("string"))


def map_side(name: Column | str) -> Column:
    """0 or 1: which of two folders a name is kept in, by the low bit of its digest."""
    return F.conv(F.right(F.md5(_c(name)), F.lit(1)), 16, 2).cast("bigint").bitwiseAND(1).cast("int")


def floor_log2(n: Column | str) -> Column:
    """The largest k with 2**k <= n; null below 1."""
    n = _c(n)
    return F.when(n >= 1, F.length(F.bin(n)) - 1).cast("int")


def ceil_log2(n: Column | str) -> Column:
    """The smallest k with 2**k >= n; null below 1."""
    n = _c(n)
    return F.when(n == 1, 0).when(n > 1, F.length(F.bin(n - 1))).cast("int")


def padded(n: Column | str, width: int = 6) -> Column:
    """A counter with zeros in front, never cut."""
    s = _c(n).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def mode_text(mode: Column | str) -> Column:
    """The nine permission bits of a file mode as rwxrwxrwx, with - for unset ones."""
    bit = lambda k: F.when(_c(mode).bitwiseAND(1 << (8 - k)) != 0, "rwx"[k % 3]).otherwise("-")
    return F.concat(*(bit(k) for k in range(9)))


def listing_row(line: Column | str) -> tuple[Column, ...]:
    """name, size, type, mtime of a tab-separated listing line; missing fields are null."""
    parts = F.split(_c(line), "\t")
    return tuple(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("name", "size", "type", "mtime")))


def bit_length(n: Column | str) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    n = _c(n)
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("int")
