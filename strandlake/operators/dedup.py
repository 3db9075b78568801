"""Exact and sampled deduplication on fingerprints, reference counts, containers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandlake.functions.hashing import leading_bits
from strandlake.runtime import hot_keys, skew_safe_join


def first_places(chunks: DataFrame, sha: str, order: list[str]) -> DataFrame:
    """One row per fingerprint: the first of its chunks by ``order``. By partial aggregation, so a common fingerprint stays small. Null fingerprints are left out."""
    others = [c for c in chunks.columns if c != sha]
    row = F.min_by(F.struct(*others), F.struct(*order))
    return chunks.where(F.col(sha).isNotNull()).groupBy(sha).agg(row.alias("__row")).select(sha, *(F.col(f"__row.{c}").alias(c) for c in others))


def dedup_totals(chunks: DataFrame, sha: str, size: str, by: list[str]) -> DataFrame:
    """Per group: chunks, unique chunks, bytes, bytes of unique chunks. Two levels of partial aggregation."""
    one = chunks.groupBy(*by, sha).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"), F.max(size).alias("u"))
    return one.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count_if(F.col(sha).isNotNull()).alias("unique_chunks"), F.sum("s").alias("bytes"), F.sum(F.when(F.col(sha).isNotNull(), F.col("u"))).alias("unique_bytes"))


def probe(chunks: DataFrame, index: DataFrame, sha: str) -> DataFrame:
    """Chunks with ``known``: whether the index has their fingerprint. Rows of a hot fingerprint are spread over tasks."""
    have = index.where(F.col(sha).isNotNull()).select(sha).distinct().withColumn("known", F.lit(True))
    out = skew_safe_join(chunks, have, [sha], "left", hot_keys(chunks, sha))
    return out.withColumn("known", F.coalesce("known", F.lit(False)))


def reference_counts(changes: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Sums of signed counts per key; entries that reach 0 are gone. Null counts are nothing."""
    return changes.groupBy(*keys).agg(F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n)).where(F.col(n) > 0)


def reclaimable(before: DataFrame, after: DataFrame, container: str) -> DataFrame:
    """Containers of ``before`` that have no entry left in ``after``."""
    return before.where(F.col(container).isNotNull()).select(container).distinct().join(after.select(container).distinct(), container, "left_anti")


def sampled(chunks: DataFrame, sha: str, rate: int, first: Column) -> DataFrame:
    """The chunks for which ``first`` holds, and those whose fingerprint starts with log2(rate) zero bits; rate a power of two up to 256."""
    power = rate.bit_length() - 1
    if rate != 1 << power or power > 8:
        raise ValueError("rate must be a power of two up to 256")
    return chunks if power == 0 else chunks.where(F.coalesce(first, F.lit(False)) | (leading_bits(sha, power) == 0))


def first_level(rows: DataFrame, levels: list[DataFrame], key: str, what: str) -> DataFrame:
    """rows with level (from 0) and ``what`` of the first of ``levels`` (key, what) that has the row's key, the smallest ``what`` there; nulls where none has.

    All levels are one table that is aggregated by key, so rows are joined once. Rows of a hot key are spread over tasks.
    """
    tagged = reduce(DataFrame.unionByName, [x.select(key, what).withColumn("level", F.lit(i)) for i, x in enumerate(levels)]).dropna()
    best = tagged.groupBy(key).agg(F.min(F.struct("level", what)).alias("__b")).select(key, "__b.level", f"__b.{what}")
    return skew_safe_join(rows, best, [key], "left", hot_keys(rows, key))


def numbered_batches(fps: DataFrame, by: list[str], fp: str, size: int) -> DataFrame:
    """fps with batch: rows of each group numbered by fingerprint, ``size`` to a batch. Ranks are taken inside groups' leading 12 bits, and sums of counts put before."""
    rows = fps.where(F.col(fp).isNotNull()).withColumn("__lead", leading_bits(fp, 12))
    n = rows.groupBy(*by, "__lead").agg(F.count(F.lit(1)).alias("__n"))
    before = n.select(*by, "__lead", (F.sum("__n").over(W.partitionBy(*by).orderBy("__lead")) - F.col("__n")).alias("__before"))
    mine = F.row_number().over(W.partitionBy(*by, "__lead").orderBy(fp)) - 1
    ranked = rows.withColumn("__mine", mine).join(before, [*by, "__lead"])
    return ranked.withColumn("batch", F.expr(f"(__before + __mine) div {size}")).drop("__lead", "__mine", "__before")


def champion(hits: DataFrame, group: list[str], candidate: str, order: str) -> DataFrame:
    """Per group the candidate with the most hits; of equals the one seen first, then the smallest. Null candidates do not count."""
    n = hits.where(F.col(candidate).isNotNull()).groupBy(*group, candidate).agg(F.count(F.lit(1)).alias("hits"), F.min(order).alias("__first"))
    best = F.min_by(F.struct(candidate, "hits"), F.struct(-F.col("hits"), F.col("__first"), F.col(candidate)))
    return n.groupBy(*group).agg(best.alias("__b")).select(*group, F.col(f"__b.{candidate}").alias(candidate), F.col("__b.hits").alias("hits"))


def free_ids(used: DataFrame, id_col: str, upto: int | None = None) -> DataFrame:
    """Ids from 1 to the largest used one, or to ``upto``, that are free, as ranges first_free, last_free, from neighbouring used ids; nothing is enumerated.

    Without used ids and ``upto`` there are none. Ids below 1 and nulls do not count.
    """
    ids = used.where(F.col(id_col) > 0).select(F.col(id_col).cast("bigint").alias(id_col))
    if upto is not None:
        # what follows upto is not looked at, and upto + 1 ends the last range
        ids = ids.where(F.col(id_col) <= upto).unionByName(used.sparkSession.range(upto + 1, upto + 2).toDF(id_col))
    ids = ids.distinct()
    buckets = ids.withColumn("__b", F.expr(f"{id_col} div 1048576"))
    inner = W.partitionBy("__b").orderBy(id_col)
    prev = buckets.withColumn("__p", F.lag(id_col).over(inner))
    # the first id of a bucket follows the last of the bucket before: one row a bucket
    edge = buckets.groupBy("__b").agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))
    chain = edge.select("lo", F.coalesce(F.lag("hi").over(W.orderBy("__b")), F.lit(0)).alias("__e"))
    gaps = prev.join(chain, prev[id_col] == chain["lo"], "left").select((F.coalesce("__p", "__e") + 1).alias("first_free"), (F.col(id_col) - 1).alias("last_free"))
    return gaps.where("first_free <= last_free")


def packed(chunks: DataFrame, group: str, order: list[str], size: str, capacity: int) -> DataFrame:
    """Chunks with box_no: appended per group in order, a new container (from 0) begun when the capacity would be exceeded.

    A running sum with resets is sequential in a group, so each group is read in order as a stream by one task, a batch at a time, never
    collected; groups are independent. A chunk over the capacity has a container of its own; null sizes take no space.
    """
    schema = StructType([*chunks.schema.fields, StructField("box_no", IntegerType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fill, box = None, 0, 0
        started = False
        for b in batches:
            sizes = b.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, out = np.r_[0, np.cumsum(sizes)], np.zeros(len(b), np.int32)
            groups = b.column(group).to_pylist()
            cuts = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if not started or groups[lo] != now:
                    now, fill, box, started = groups[lo], 0, 0, True
                k = lo
                while k < hi:  # a step a container
                    end = min(hi, int(np.searchsorted(total[k + 1 :], capacity - fill + total[k], "right")) + k)
                    if end == k and fill:
                        fill, box = 0, box + 1
                        continue
                    end = max(end, k + 1)
                    out[k:end] = box
                    fill += int(total[end] - total[k])
                    k = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=names)

    return chunks.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
