"""Shared storage, lineage cuts and skew handling used by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with a larger share of the rows than this is treated as hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01
#: Tasks over which a hot key is spread.
SALTS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset (a single machine, tests) is a temporary folder made, set as the
    checkpoint folder of the session and removed at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="strandlake-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    return "file://" + at


_MADE: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; see clear."""
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables and indexes that this process has made in the shared folder; their number. For when no result that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    while _MADE:
        at = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written as a Parquet table in the shared folder and read again: a cut of the lineage that survives the loss of executors."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The values of ``key`` that more than ``share`` of the rows have, at most 1 / share of them.

    A frequent-items sketch misses no such value but names others too; where it names any, a second pass counts those. Nulls do not count.
    """
    some = df.select(key).where(F.col(key).isNotNull())
    got = some.stat.freqItems([key], max(share, 1e-4)).collect()
    named = [x for x in (got[0][0] or [])] if got else []
    if not named:
        return []
    counts = some.groupBy(F.when(F.col(key).isin(named), F.col(key)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    return sorted(r["k"] for r in counts if r["k"] is not None and r["n"] > share * total)


def skew_safe_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, hot: list | None = None, share: float = HOT_SHARE) -> DataFrame:
    """``big.join(small, on, how)`` for a ``small`` with few rows per key, in one pass and without sending a hot key's rows to one task.

    how: inner, left, left_semi or left_anti. The rows of big with a hot first key column are spread over SALTS tasks by a digest of
    the whole row, and the rows of small with such a key (those of at most 1 / share keys) are repeated for each. Rows with a null
    first key, which meet nothing, are spread likewise. hot: the hot keys, where they are known; else one pass finds them.
    """
    key = on[0]
    hot = hot_keys(big, key, share) if hot is None else hot
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
    heavy = F.col(key).isNull() | (F.col(key).isin(hot) if hot else F.lit(False))
    left = big.withColumn("__salt", F.when(heavy, spread).otherwise(F.lit(0)))
    if hot:
        salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        right = small.withColumn("__salt", F.explode(salts))
    else:
        right = small.withColumn("__salt", F.lit(0))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
