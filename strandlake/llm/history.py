"""Deduplicating new batches against all history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.runtime import SALTS, hot_keys, shared_path, skew_safe_join, written

_POSTINGS = "h bigint, item binary, holder_id bigint, batch_no bigint, run string, bucket int"
_SIZES = "holder_id bigint, batch_no bigint, n bigint, run string"


def records(rows: DataFrame) -> DataFrame:
    """record_id, batch_no, n, h, item: the distinct items of each record (rows: record_id, item, batch_no) with their hash and their number.

    Nulls in any column are dropped, so a record without items has no row; one in several batches counts with the earliest.
    """
    rows = rows.select("record_id", F.col("item").cast("binary").alias("item"), F.col("batch_no").cast("bigint").alias("batch_no")).dropna()
    items = rows.groupBy("record_id", "item").agg(F.min("batch_no").alias("batch_no"))
    whole = items.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min("batch_no").alias("batch_no"))
    return whole.join(items.select("record_id", F.xxhash64("item").alias("h"), "item"), "record_id").select("record_id", "batch_no", "n", "h", "item")


class HistoryIndex:
    """Band keys of what holders have taken in so far, in folders by append and hash bucket on shared storage, with the holders' sizes.

    A batch's record is *held* by a holder if at least num/den of its distinct items are among the holder's items of earlier batches.
    A holder may be much larger than the record, so minwise values of both sets need not agree. But a record that misses at most m
    of its n items has one of any m + 1 of them in the holder. Its bands are therefore its m + 1 minwise items, a row each, rare ones
    first and ties by hash; and on the holders' side every item is a band key, as it may be among a record's. That is exact, where bands of
    several values only make a hit likely.

    A probe opens only the bucket folders that its records' items hash to, and of these reads on only the rows with such an item:
    candidates and weights come from them. Appends add a folder and never touch what is there; an append counts once its sizes are
    written, so one that breaks off leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path or shared_path(spark, "history"), buckets

    def _bucket(self):
        return F.pmod(F.shiftright("h", 20), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        """Add rows (holder_id, item, batch_no). Nulls in any of them and repeats are dropped. A hot item's rows are written by many tasks."""
        rows = rows.select(F.col("item").cast("binary").alias("item"), F.col("holder_id").cast("bigint").alias("holder_id"), F.col("batch_no").cast("bigint").alias("batch_no")).dropna()
        keyed = rows.withColumn("h", F.xxhash64("item")).withColumn("bucket", self._bucket())
        hot = hot_keys(keyed, "h")
        by = ["bucket"]
        if hot:
            keyed = keyed.withColumn("salt", F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("holder_id"), F.lit(SALTS))).otherwise(F.lit(0)))
            by.append("salt")
        # the rows of a bucket are in one task, and stay there for the grouping
        out = keyed.repartition(*by).groupBy(*by, "h", "item", "holder_id").agg(F.min("batch_no").alias("batch_no"))
        run = uuid.uuid4().hex[:12]
        at = f"{self.path}/postings/run={run}"
        out.select("bucket", "h", "item", "holder_id", "batch_no").sortWithinPartitions("bucket", "h").write.option("compression", "zstd").partitionBy("bucket").parquet(at)
        made = self.spark.read.schema("holder_id bigint, batch_no bigint").parquet(at)
        made.groupBy("holder_id", "batch_no").agg(F.count(F.lit(1)).alias("n")).coalesce(4).write.parquet(f"{self.path}/sizes/run={run}")

    def runs(self) -> list[str]:
        """The appends that are complete."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(p.getPath().getName()[4:] for p in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS")))

    def _read(self, what: str, schema: str) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*(f"{self.path}/{what}/run={r}" for r in runs))

    def compact(self) -> None:
        """Write all appends into one; a holder's repeats of an item are dropped. What was there before is left out from then on, and removed."""
        old = self.runs()
        if len(old) < 2:
            return
        self.append(self._read("postings", _POSTINGS).select("holder_id", "item", "batch_no"))
        jvm = self.spark.sparkContext._jvm
        for r in old:
            for what in ("sizes", "postings"):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/run={r}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def matching(self, items: DataFrame) -> DataFrame:
        """The postings whose hash is among those of items (h), from the buckets of these only."""
        buckets = sorted(r[0] for r in items.select(self._bucket().alias("b")).distinct().collect())
        found = self._read("postings", _POSTINGS).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return found.join(items.select("h").distinct(), "h", "left_semi").select("h", "item", "holder_id", "batch_no")

    def probe(self, rows: DataFrame, num: int = 4, den: int = 5, prepared: bool = False) -> DataFrame:
        """record_id, holder_id, overlap, n of each record that an earlier holder holds to num/den or more.

        rows: record_id, item, batch_no, or with ``prepared`` what ``records`` makes of them. Holders' items count with batches smaller than
        the record's.
        """
        items = rows if prepared else written(records(rows), "records")
        near = written(self.matching(items), "matching").groupBy("h", "item", "holder_id").agg(F.min("batch_no").alias("first_batch"))
        weight = near.groupBy("h").agg(F.count(F.lit(1)).alias("holders"))
        hot = hot_keys(items, "h")
        # what no holder has cannot be met, but takes its places among the bands: it comes first
        weighed = skew_safe_join(items.select("record_id", "batch_no", "n", "h"), weight, ["h"], "left", hot)
        by = W.partitionBy("record_id").orderBy(F.coalesce("holders", F.lit(0)), "h")
        need = F.expr(f"(n * {num} + {den - 1}) div {den}")
        bands = weighed.withColumn("place", F.row_number().over(by)).where((F.col("place") <= F.col("n") - need + 1) & F.col("holders").isNotNull())
        earlier = F.col("first_batch") < F.col("batch_no")
        met = skew_safe_join(near.select("h", "holder_id", "first_batch"), bands.select("h", "record_id", "batch_no", need.alias("need")), ["h"], "inner", hot).where(earlier)
        sizes = self._read("sizes", _SIZES).groupBy("holder_id").agg(F.sum("n").alias("holder_n"))
        fits = met.select("record_id", "holder_id", "need").distinct().join(sizes, "holder_id").where(F.col("holder_n") >= F.col("need")).select("record_id", "holder_id")
        # verification: the items of each candidate pair, one by one
        pairs = items.join(fits, "record_id")
        both = skew_safe_join(pairs, near, ["h", "holder_id", "item"], "inner", hot).where(earlier)
        found = both.groupBy("record_id", "holder_id").agg(F.count(F.lit(1)).alias("overlap"), F.first("n").alias("n"))
        return found.where(F.col("overlap") >= need)

    def admit(self, rows: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
        """Probe a batch, append the items of the accepted records, each as its own holder, and return record_id, holder_id, overlap, n of the others.

        In the batch, records are taken by their number: one that a smaller, accepted one holds is not accepted either. Each round settles
        the records all of whose smaller holders are settled, so rounds grow with the longest chain of such holders.
        """
        items = written(records(rows), "records")
        held = written(self.probe(items, num, den, prepared=True), "held")
        left = items.join(held.select("record_id").distinct(), "record_id", "left_anti")
        own = HistoryIndex(self.spark, buckets=self.buckets)
        own.append(left.select(F.col("record_id").alias("holder_id"), "item", F.col("record_id").alias("batch_no")))
        twins = written(own.probe(left.withColumn("batch_no", F.col("record_id")), num, den, prepared=True), "twins")
        open_pairs, out = twins, None
        while not open_pairs.isEmpty():
            late = open_pairs.select(F.col("record_id").alias("holder_id")).distinct()
            firm = open_pairs.join(late, "holder_id", "left_anti")  # these holders wait for nobody: they are accepted
            lost = firm.select("record_id").distinct()
            out = firm if out is None else out.unionByName(firm)
            rest = open_pairs.join(lost, "record_id", "left_anti")
            open_pairs = written(rest.join(lost.withColumnRenamed("record_id", "holder_id"), "holder_id", "left_anti"), "twins")
        gone = held if out is None else written(held.unionByName(out), "refused")
        self.append(items.join(gone.select("record_id").distinct(), "record_id", "left_anti").select(F.col("record_id").alias("holder_id"), "item", "batch_no"))
        return gone
