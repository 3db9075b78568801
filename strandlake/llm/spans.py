"""Long exact spans shared between records: a log-structured index of window hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.letters import Letters, runs_of
from strandlake.runtime import hot_keys, shared_path, skew_safe_join, written

#: Up to so many shared texts (about 20 MB) are sent to where the places are; beyond, both are joined by text.
MARKS = 500_000
#: Letters that two 64-bit numbers hold, two bits each.
PACKED = 64


def _anchors(window: int, seed: int, min_letters: int, packed: bool, schema: pa.Schema):
    most = PACKED - window + 1 if packed else PACKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per run of neighbouring windows with the same anchor: the anchor's hash and the text of the run."""
        for b in batches:
            text = Letters(b.column("seq"))
            codes, ok = text.grams(seed)
            h = text.mix(codes)
            n, w = len(h), window - seed + 1
            if n < w or not len(text.data):
                continue
            h[~ok] = np.uint64(0xFFFFFFFFFFFFFFFF)
            # leftmost smallest hash of each window, by doubling: least[i] over span letters from i
            least, span = np.arange(n), 1
            while span * 2 <= w:
                a, c = least[:-span], least[span:]
                least = np.where(h[c] < h[a], c, a)
                span *= 2
            if span < w:
                a, c = least[: n - w + 1], least[w - span : w - span + n - w + 1]
                least = np.where(h[c] < h[a], c, a)
            least = least[: n - w + 1]
            counts = text.good_windows(window, min_letters)[: len(least)]
            at = np.flatnonzero(counts)
            if not len(at):
                continue
            anchor = least[at]
            first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
            # a run is no longer than its text can be
            turn = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            s = np.flatnonzero(turn % most == 0)
            e = np.r_[s[1:], len(at)] - 1
            lo, hi = at[s], at[e] + window
            rec = text.row_of(lo)
            if packed:
                # the first 32 letters, and the rest from the top of another number
                code, _ = text.grams(min(32, window))
                short = np.uint64(2 * (32 - min(32, window)))
                one = code[lo] << short
                rest = np.maximum(hi - lo - 32, 0)
                two = np.zeros(len(lo), np.uint64)
                if window >= 32:
                    two = np.where(rest > 0, code[hi - 32] << (64 - 2 * np.minimum(rest, 32)).astype(np.uint64), np.uint64(0))
                texts = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            else:
                whole = text.data.tobytes().decode("latin-1")
                texts = [pa.array([whole[i:j] for i, j in zip(lo.tolist(), hi.tolist())], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(h[anchor[s]].view(np.int64)), *texts, pa.array((hi - lo).astype(np.int32)), b.column("rec_no").take(pa.array(rec)), pa.array((lo - text.starts[rec]).astype(np.int32))], schema=schema)

    return run


class SpanIndex:
    """Sorted, immutable runs of window hashes on shared storage, merge-joined with each new batch and compacted as they pile up.

    Of the ``seed``-letter grams in each window of ``window`` letters the one with the smallest hash is the window's anchor, so two equal
    windows have equal anchors. For each stretch of neighbouring windows with one anchor a run keeps, in ``texts``, (hash, text, smallest
    and largest record that has it), a row per different text, bucketed and sorted by hash; and in ``places`` (text, record, start), as they
    came. So a text of very many records is one row before it is shuffled, and a batch meets the texts of earlier runs bucket by
    bucket, without moving these. Texts are two numbers, two bits a letter, where ``2 * window - seed`` letters fit, else strings.

    A batch (``add``) is written as a run, its hashes are merge-joined with the earlier runs' texts, hits are verified by the windows
    themselves, and the stretches that it makes shared, in its own records and in earlier ones, are stored beside the run. What was
    shared before stays shared, so ``shared_stretches`` is the union of these. The index is what lies in ``path``: another session opens
    it by that name.
    """

    def __init__(self, spark: SparkSession, window: int = 40, seed: int = 24, min_letters: int = 3, buckets: int | None = None, path: str | None = None):
        self.spark, self.window, self.seed, self.min_letters, self.path = spark, window, seed, min_letters, path or shared_path(spark, "spans")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.packed = 32 <= window and 2 * window - seed <= PACKED
        self.cols = ["a", "b", "n"] if self.packed else ["span", "n"]
        kinds = {"h": pa.int64(), **({"a": pa.int64(), "b": pa.int64()} if self.packed else {"span": pa.string()}), "n": pa.int32(), "rec_no": pa.int64(), "start": pa.int32()}
        self._schema = pa.schema(list(kinds.items()))
        names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}
        self._ddl = {c: f"{c} {names[t]}" for c, t in kinds.items()}
        self._tables: dict[str, str] = {}

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    @property
    def runs(self) -> list[str]:
        """Names of the complete runs, oldest first: a run is there once its stretches are written."""
        fs, at = self._fs()
        if not fs.exists(at(f"{self.path}/found")):
            return []
        return sorted(p.getPath().getName() for p in fs.listStatus(at(f"{self.path}/found")) if fs.exists(at(p.getPath(), "_SUCCESS")))

    def anchors(self, records: DataFrame) -> DataFrame:
        """h, text, n, rec_no, start of records (rec_no, seq); nulls, and records shorter than a window, have none."""
        rows = records.select(F.col("rec_no").cast("bigint").alias("rec_no"), F.upper(F.regexp_replace("seq", "\r+$", "")).alias("seq"))
        rows = rows.where(F.col("rec_no").isNotNull() & (F.length("seq") >= self.window))
        return rows.mapInArrow(_anchors(self.window, self.seed, self.min_letters, self.packed, self._schema), ", ".join(self._ddl.values()))

    def _texts(self, run: str) -> DataFrame:
        """A run's texts, as a table whose buckets and order the session knows."""
        name = self._tables.get(run)
        if name is None:
            name, (buckets, at) = f"span_{uuid.uuid4().hex[:12]}", (run.split("_")[1], f"{self.path}/texts/{run}")
            cols = ", ".join([*(self._ddl[c] for c in ("h", *self.cols)), "lo bigint", "hi bigint"])
            self.spark.sql(f"create table {name} ({cols}) using parquet clustered by (h) sorted by (h) into {buckets} buckets location '{at}'")
            self._tables[run] = name
        return self.spark.table(name)

    def _write_texts(self, rows: DataFrame, run: str) -> None:
        name = f"span_{uuid.uuid4().hex[:12]}"
        out = rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
        out.option("compression", "zstd").option("path", f"{self.path}/texts/{run}").format("parquet").saveAsTable(name)
        self._tables[run] = name

    def _places(self, run: str) -> DataFrame:
        return self.spark.read.schema(", ".join(self._ddl[c] for c in (*self.cols, "rec_no", "start"))).parquet(f"{self.path}/places/{run}")

    def _name(self) -> str:
        last = int(self.runs[-1].split("_")[0]) if self.runs else 0
        return f"{last + 1:06d}_{self.buckets}_{uuid.uuid4().hex[:8]}"

    def add(self, records: DataFrame) -> DataFrame:
        """Write a batch as a run; return the stretches (rec_no, rec_offset, match_len) that it makes shared, also those of earlier records."""
        old, run = self.runs, self._name()
        rows = self.anchors(records)
        rows.select(*self.cols, "rec_no", "start").write.option("compression", "zstd").parquet(f"{self.path}/places/{run}")
        self._write_texts(rows.groupBy("h", *self.cols).agg(F.min("rec_no").alias("lo"), F.max("rec_no").alias("hi")), run)
        self._stretches(run, old).write.option("compression", "zstd").parquet(f"{self.path}/found/{run}")
        return self._found([run])

    def _window(self) -> list[Column]:
        """The window at offset o of a text."""
        if not self.packed:
            return [F.expr(f"substring(span, o + 1, {self.window})").alias("w1")]
        one = F.expr("case when o = 0 then a else shiftleft(a, 2 * o) | shiftrightunsigned(b, 64 - 2 * o) end")
        two = F.expr(f"shiftrightunsigned(shiftleft(b, 2 * o), {64 - 2 * (self.window - 32)})") if self.window > 32 else F.lit(0).cast("bigint")
        return [one.alias("w1"), two.alias("w2")]

    def _stretches(self, run: str, old: list[str]) -> DataFrame:
        ends = lambda d: d.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        new = self._texts(run)
        hashes = ends(new)
        # a merge join of each earlier run with the batch's hashes, bucket by bucket
        met = [ends(self._texts(r).join(hashes.select("h").hint("merge"), "h", "left_semi")) for r in old]
        both = ends(reduce(DataFrame.unionByName, [hashes, *met])) if met else hashes
        common = both.where("lo < hi").select("h")
        near = [self._texts(r).join(common.hint("merge"), "h", "left_semi").withColumn("new", F.lit(r == run)) for r in [run, *old]]
        near = reduce(DataFrame.unionByName, near)
        # verification by the windows themselves: equal anchors need not mean equal windows
        each = near.select(*self.cols, "lo", "hi", "new", F.explode(F.sequence(F.lit(0), F.col("n") - self.window)).alias("o"))
        names = ["w1", "w2"] if self.packed else ["w1"]
        windows = each.select(*self.cols, "lo", "hi", "new", "o", *self._window())
        # texts are different, so a window stands in as many rows as there are ways to go on from it, however many records have it
        of = W.partitionBy(*names)
        told = windows.withColumns({"least": F.min("lo").over(of), "most": F.max("hi").over(of), "fresh": F.max("new").over(of)})
        hits = told.where("least < most and fresh").select(*self.cols, "o")
        # a text has at most 64 windows: the shared ones are the bits of a number
        marks = hits.groupBy(*self.cols).agg(F.expr("bit_or(shiftleft(1L, o))").alias("mark"))
        places = reduce(DataFrame.unionByName, [self._places(r) for r in [run, *old]])
        marks = written(marks, "marks")
        if len(marks.limit(MARKS + 1).select("mark").toArrow()) <= MARKS:
            at = places.join(F.broadcast(marks), self.cols)
        else:
            at = skew_safe_join(places, marks, self.cols, "inner", hot_keys(self._places(run), self.cols[0]))
        offsets = F.filter(F.sequence(F.lit(0), F.col("n") - self.window), lambda o: F.call_function("getbit", F.col("mark"), o) == 1)
        found = at.select("rec_no", "start", F.explode(offsets).alias("o")).select("rec_no", (F.col("start") + F.col("o")).alias("pos"))
        return runs_of(found.distinct(), self.window)

    def _found(self, runs: list[str]) -> DataFrame:
        schema = "rec_no bigint, rec_offset int, match_len int"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/found/{r}" for r in runs)) if runs else self.spark.createDataFrame([], schema)

    def shared_stretches(self) -> DataFrame:
        """rec_no, rec_offset, match_len: each maximal run of letters that shared windows cover, over all batches."""
        rows = self._found(self.runs).distinct()
        by = W.partitionBy("rec_no").orderBy("rec_offset", "match_len")
        end = F.col("rec_offset") + F.col("match_len")
        before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
        marked = rows.withColumn("fresh", F.when(F.col("rec_offset") <= before, 0).otherwise(1))
        runs = marked.withColumn("run", F.sum("fresh").over(by))
        return runs.groupBy("rec_no", "run").agg(F.min("rec_offset").alias("rec_offset"), (F.max(end) - F.min("rec_offset")).cast("int").alias("match_len")).select("rec_no", "rec_offset", "match_len")

    def compact(self) -> None:
        """Merge all runs into one, by merging their sorted texts. The old runs are removed once the new one is complete."""
        old = self.runs
        if len(old) < 2:
            return
        run = self._name()
        reduce(DataFrame.unionByName, [self._places(r) for r in old]).write.option("compression", "zstd").parquet(f"{self.path}/places/{run}")
        texts = reduce(DataFrame.unionByName, [self._texts(r) for r in old])
        self._write_texts(texts.groupBy("h", *self.cols).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), run)
        self.shared_stretches().write.option("compression", "zstd").parquet(f"{self.path}/found/{run}")
        fs, at = self._fs()
        for r in old:
            for what in ("found", "places", "texts"):
                fs.delete(at(f"{self.path}/{what}/{r}"), True)
            self.spark.sql(f"drop table if exists {self._tables.pop(r, 'none')}")


def shared_portion(stretches: DataFrame, records: DataFrame) -> DataFrame:
    """rec_no, letters, shared, portion of each record; null portion for records without letters."""
    size = records.where(F.col("rec_no").isNotNull()).groupBy("rec_no").agg(F.max(F.coalesce(F.length(F.regexp_replace("seq", "\r+$", "")), F.lit(0))).cast("bigint").alias("letters"))
    part = stretches.groupBy("rec_no").agg(F.sum("match_len").alias("shared"))
    out = size.join(part, "rec_no", "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
    return out.withColumn("portion", F.when(F.col("letters") > 0, F.col("shared") / F.col("letters")))
