"""Normal forms of fingerprints and composite ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint(sha: Column | str) -> Column:
    """The 20 bytes that a sha stands for, as binary; null for what is no fingerprint.

    Blanks and tabs around it, a leading 0x and letter case do not matter.
    """
    digits = F.regexp_extract(_c(sha), r"^[ \t]*(?:0[xX])?([0-9a-fA-F]{40})[ \t]*$", 1)
    return F.when(digits != "", F.unhex(digits))


def cid_part(cid: Column | str, which: int) -> Column:
    """Number ``which`` (1 inode, 2 client) of an ``inode_client`` id without leading zeros, as string.

    Blanks and NULs around it do not matter. Null if that number is missing or unreadable, or the id is null or empty.
    """
    n = r"^[\s\x00]*(?:0*([0-9]+))?_(?:0*([0-9]+))?[\s\x00]*$"
    part = F.regexp_extract(_c(cid), n, which)
    return F.when(part != "", part)


def cid_given(cid: Column | str) -> Column:
    """True if there is an id at all: neither null nor empty, blanks and NULs aside."""
    return F.coalesce(F.regexp_replace(_c(cid), r"[\s\x00]", "") != "", F.lit(False))
