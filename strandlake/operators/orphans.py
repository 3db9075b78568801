"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import hot_keys, skew_safe_join

MATCHES = ("simple", "partial", "full")


def _same(keys: Sequence[str], mask: Sequence[bool]) -> Column:
    """True for rows whose keys are non-null exactly where mask is True."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() if m else F.col(k).isNull() for k, m in zip(keys, mask)])


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    ref_keys: Sequence[str],
    target_keys: Sequence[str],
    match: str = "simple",
    ref_time: str | None = None,
    target_from: str | None = None,
    target_live: Column | None = None,
    grace_seconds: int = 0,
) -> DataFrame:
    """The rows of ``refs`` that refer to a row of ``targets`` that is missing, deleted or comes too late; columns as in ``refs``.

    References are grouped by their null mask (which key columns are null), and each mask is anti-joined on its non-null columns,
    as the declared match says (as for SQL foreign keys):

    * ``simple``: a reference with any null key is satisfied; only the mask without nulls is joined.
    * ``full``: a reference with only nulls is satisfied, one with some nulls is an orphan.
    * ``partial``: a reference with only nulls is satisfied, one with some nulls needs a target that is equal in the others.

    A target counts if ``target_live`` holds and, with ``ref_time``, if its ``target_from`` is at most ``grace_seconds`` after the
    reference's time; a null on either side of this comparison does not satisfy it. Target rows with a null key are never met in that key.

    Rows sent twice stay twice. Empty ``targets`` make all references orphans but those that the match excuses; other columns
    of ``targets`` are not read, so clashing names do no harm. Targets are reduced to one row per key (its earliest time) before
    the join, and the rows of hot reference keys, and those with null keys, are spread over tasks.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if len(ref_keys) != len(target_keys) or not ref_keys:
        raise ValueError("as many ref_keys as target_keys, one at least")
    k = len(ref_keys)
    names = [f"__orphan_k{i}" for i in range(k)]
    timed = ref_time is not None
    live = targets if target_live is None else targets.where(target_live)
    live = live.select(*(F.col(c).alias(n) for c, n in zip(target_keys, names)), (F.col(target_from) if timed else F.lit(None)).alias("__orphan_from"))
    if timed:
        live = live.where(F.col("__orphan_from").isNotNull())
    rows = refs.select("*", *(F.col(c).alias(n) for c, n in zip(ref_keys, names)))

    def met(on: list[str], rows: DataFrame) -> DataFrame:
        """rows with __orphan_met: true for those with a target that is equal in the columns ``on``."""
        have = live.where(_same(on, [True] * len(on))).groupBy(*on).agg(F.min("__orphan_from").alias("__orphan_from"), F.lit(True).alias("__orphan_met"))
        lead = ["__orphan_h", *on]
        rows = rows.withColumn("__orphan_h", F.when(_same(on, [True] * len(on)), F.xxhash64(*on)))
        joined = skew_safe_join(rows, have.withColumn("__orphan_h", F.xxhash64(*on)), lead, "left", hot_keys(rows, "__orphan_h"))
        ok = F.col("__orphan_met").isNotNull()
        if timed:
            ok = ok & (F.col("__orphan_from") <= F.col(ref_time) + F.expr(f"interval {int(grace_seconds)} seconds"))
        return joined.withColumn("__orphan_met", F.coalesce(ok, F.lit(False)))

    def pick(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{c}`") for c in refs.columns))

    whole, none = _same(names, [True] * k), _same(names, [False] * k)
    if match != "partial":  # one pass: only the mask without nulls is joined, the match alone decides on the others
        excused = none if match == "full" else ~whole
        return pick(met(names, rows).where(~excused & ~F.col("__orphan_met")))
    parts = []
    for mask in product([True, False], repeat=k):
        if any(mask):
            on = [n for n, m in zip(names, mask) if m]
            parts.append(pick(met(on, rows.where(_same(names, mask))).where(~F.col("__orphan_met"))))
    return reduce(DataFrame.unionByName, parts)


def orphans_by_period(orphans: DataFrame, table: str, when: str, period: str = "month") -> DataFrame:
    """Counts of orphan rows per ``table`` column and calendar period of ``when``: columns ``table``, period_start, orphans. Rows without a time have a null period."""
    start = F.date_trunc(period, F.col(when))
    return orphans.groupBy(F.col(table), start.alias("period_start")).agg(F.count(F.lit(1)).alias("orphans"))
