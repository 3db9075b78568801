"""Has this key been seen before? Short fingerprints in partitioned cuckoo tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.runtime import hot_keys, shared_path, written

SLOTS = 4
KICKS = 200


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Table:
    """One cuckoo table: buckets of SLOTS 16-bit fingerprints; a key's buckets are i and i xor mix(fingerprint)."""

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.fill = np.zeros(buckets, np.int8)
        self.kept = 0

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        short = (h >> np.uint64(48)).astype(np.uint16)
        short[short == 0] = 1
        one = (h & self.mask).astype(np.int64)
        return short, one, self.other(one, short)

    def other(self, at: np.ndarray, short: np.ndarray) -> np.ndarray:
        return ((at.astype(np.uint64) ^ _mix(short.astype(np.uint64))) & self.mask).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        short, one, two = self.places(h)
        s = short[:, None]
        return (self.slots[one] == s).any(1) | (self.slots[two] == s).any(1)

    def _put(self, at: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Put as many as there is room for; True for those that were put."""
        order = np.argsort(at, kind="stable")
        a = at[order]
        new = np.r_[True, a[1:] != a[:-1]]
        rank = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        slot = self.fill[a] + rank
        ok = slot < SLOTS
        self.slots[a[ok], slot[ok]] = short[order[ok]]
        np.add.at(self.fill, a[ok], 1)
        self.kept += int(ok.sum())
        done = np.zeros(len(a), bool)
        done[order[ok]] = True
        return done

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add keys; the fingerprints and buckets that found no room come back (of keys added now or pushed out by them)."""
        short, one, two = self.places(h)
        left = ~self._put(one, short) if len(h) else np.zeros(0, bool)
        if left.any():
            at = np.flatnonzero(left)
            left[at[self._put(two[at], short[at])]] = False
        lost: list[tuple[int, int]] = []
        for k in np.flatnonzero(left):
            s, at = short[k], int(two[k])
            for turn in range(KICKS):
                if self.fill[at] < SLOTS:
                    self.slots[at, self.fill[at]] = s
                    self.fill[at] += 1
                    self.kept += 1
                    break
                v = turn % SLOTS
                s, self.slots[at, v] = self.slots[at, v], s
                at = int(self.other(np.array([at]), np.array([s]))[0])
            else:
                lost.append((int(s), at))
        return np.array([x[0] for x in lost], np.uint16), np.array([x[1] for x in lost], np.int64)

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Take out one copy of each key; False where there is none. A key of each bucket at a time, so rounds are as many as keys of one bucket."""
        short, one, two = self.places(h)
        gone = np.zeros(len(h), bool)
        for place in (one, two):
            todo = np.flatnonzero(~gone)
            while len(todo):
                _, first = np.unique(place[todo], return_index=True)
                now = todo[first]
                at = place[now]
                hit = self.slots[at] == short[now, None]
                ok = hit.any(1)
                now, at, slot = now[ok], at[ok], hit[ok].argmax(1)
                last = self.fill[at] - 1
                self.slots[at, slot] = self.slots[at, last]
                self.slots[at, last] = 0
                self.fill[at] = last
                self.kept -= len(now)
                gone[now] = True
                todo = np.delete(todo, first)
        return gone


class CuckooFilter:
    """A chain of cuckoo tables that grows: a saturated table is followed by one of twice its size. Keys are 64-bit hashes.

    No key that was added and not removed is ever denied; a key that was not may be affirmed by chance, with about
    2 * SLOTS / 2**16 per full table of the chain. Only keys that were added may be removed; ``seen`` does not add a key that it affirms
    by chance, so whoever removes keys adds those first (SeenKeys does).
    """

    def __init__(self, buckets: int = 1024, load: float = 0.9):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.load, self.tables = load, [_Table(buckets)]

    def __len__(self) -> int:
        return sum(t.kept for t in self.tables)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h, out = _mix(keys.view(np.uint64)), np.zeros(len(keys), bool)
        for t in self.tables:
            out |= t.has(h)
        return out

    def add(self, keys: np.ndarray) -> None:
        h = _mix(keys.view(np.uint64))
        while len(h):
            t = self.tables[-1]
            room = int(self.load * t.slots.size) - t.kept
            if room <= 0:
                self.tables.append(_Table(2 * len(t.slots)))
                continue
            short, at = t.add(h[:room])
            h = h[room:]
            if len(short):  # pushed out without a place: a fingerprint and its bucket are all that is needed further up
                big = _Table(2 * len(t.slots))
                self.tables.append(big)
                self._carry(big, t, short, at)

    def _carry(self, big: _Table, small: _Table, short: np.ndarray, at: np.ndarray) -> None:
        """Keep fingerprints that the full table ``small`` pushed out in that table's next sibling of the same size, so that their buckets hold."""
        spare = _Table(len(small.slots))
        for s, a in zip(short, at):
            for b in (int(a), int(spare.other(np.array([a]), np.array([s]))[0])):
                if spare.fill[b] < SLOTS:
                    spare.slots[b, spare.fill[b]] = s
                    spare.fill[b] += 1
                    spare.kept += 1
                    break
            else:
                raise OverflowError("more fingerprints pushed out than two buckets hold")
        self.tables.insert(-1, spare)

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Remove one copy of each key, all of which were added; True for those that were removed.

        A key that several tables affirm is left: all but one of them do so by another key's fingerprint, which must stay. It goes on
        being affirmed by chance, as one in some thousands is.
        """
        h, out = _mix(keys.view(np.uint64)), np.zeros(len(keys), bool)
        has = np.array([t.has(h) for t in self.tables])
        sure = has.sum(0) == 1
        for t, mine in zip(self.tables, has):
            at = np.flatnonzero(mine & sure)
            out[at] = t.remove(h[at])
        return out

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """For keys in order of arrival: may it have come before? Keys that have not are added."""
        out = self.contains(keys)
        new = np.flatnonzero(~out)
        _, first = np.unique(keys[new], return_index=True)
        again = np.ones(len(new), bool)
        again[first] = False
        out[new[again]] = True
        self.add(keys[new[~again]])
        return out

    def to_bytes(self) -> bytes:
        parts = [np.array([len(t.slots) for t in self.tables] + [0], np.int64).tobytes()]
        return b"".join(parts + [t.slots.tobytes() for t in self.tables])

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out, sizes, at = cls.__new__(cls), [], 0
        while (n := int(np.frombuffer(data, np.int64, 1, at)[0])) != 0:
            sizes.append(n)
            at += 8
        at += 8
        out.load, out.tables = 0.9, []
        for n in sizes:
            t = _Table(n)
            t.slots = np.frombuffer(data, np.uint16, n * SLOTS, at).reshape(n, SLOTS).copy()
            t.fill = (t.slots != 0).sum(1).astype(np.int8)
            t.kept = int(t.fill.sum())
            out.tables.append(t)
            at += t.slots.nbytes
        return out


#: What a row of a pass is, in the order in which a part's rows come.
STORED, FORCED, GONE, ASKED = range(4)

_OUT = pa.schema([("part", pa.int32()), ("row_id", pa.int64()), ("key", pa.binary()), ("h", pa.int64()), ("arrival", pa.int64()), ("wanted", pa.bool_()), ("tables", pa.binary())])
_OUT_DDL = "part int, row_id bigint, key binary, h bigint, arrival bigint, wanted boolean, tables binary"


def _pass(keep: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part; in a part first the stored tables, then keys to add and to take out, then those asked by arrival."""
        part, held, last = None, None, None

        def end() -> Iterator[pa.RecordBatch]:
            if keep and held is not None:
                none = {c: [None] for c in _OUT.names}
                yield pa.RecordBatch.from_pydict(none | {"part": [part], "tables": [held.to_bytes()]}, _OUT)

        for b in batches:
            parts = b.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if parts[lo] != part:
                    yield from end()
                    part, held, last = int(parts[lo]), CuckooFilter(buckets), None
                piece = b.slice(lo, hi - lo)
                kind = piece.column("kind").to_numpy(zero_copy_only=False)
                at = np.searchsorted(kind, [FORCED, GONE, ASKED])
                for k in range(at[0]):
                    held = CuckooFilter.from_bytes(piece.column("tables")[k].as_py())
                hashes = lambda i, j: piece.column("h").slice(i, j - i).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                held.add(hashes(at[0], at[1]))
                held.remove(hashes(at[1], at[2]))
                piece = piece.slice(int(at[2]))
                if len(piece):
                    # rows of one key and arrival are one question; the first one's answer holds for all, over batches too
                    h, when = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("h", "arrival"))
                    new = np.r_[True, (h[1:] != h[:-1]) | (when[1:] != when[:-1])]
                    answer = np.zeros(len(h), bool)
                    on = last is not None and last[:2] == (h[0], when[0])
                    ask = np.flatnonzero(new)[1 if on else 0 :]
                    answer[ask] = held.seen(h[ask])
                    if on:
                        answer[0] = last[2]
                    maybe = answer[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
                    last = (h[-1], when[-1], bool(maybe[-1]))
                    got = piece.filter(pa.array(maybe))
                    if len(got):
                        yield pa.RecordBatch.from_arrays([got.column(n) for n in _OUT.names], schema=_OUT)
        yield from end()

    return run


def cuckoo_pass(rows: DataFrame, parts: int = 32, tables: DataFrame | None = None, keep: bool = False, buckets: int = 1024, forced: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Probe and fill partitioned cuckoo tables with keys in order of arrival.

    rows: row_id, key (binary, not null), arrival, wanted. A key's hash names its part; each part is one task's table, read in order of
    arrival with Arrow batches, so no task holds more than the table and a batch. Rows with the same key and arrival, as those sent
    twice, go through the table once.
    tables: (part, tables) of an earlier pass, to go on from it; forced: distinct keys (key) to be added first, whether the tables affirm
    them or not; gone: distinct keys (key) to be taken out then, each of which must have been added. Returns part, row_id, key, h,
    arrival, wanted of the rows whose key *may* have come before (none that has is missing) and, with keep, a row per part with its tables.
    """
    part = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(parts)).cast("int").alias("part")
    null = lambda t: F.lit(None).cast(t)
    asked = rows.select(part, F.col("row_id").cast("bigint").alias("row_id"), "key", F.col("arrival").cast("bigint").alias("arrival"), F.xxhash64("key").alias("h"), "wanted", F.lit(ASKED).alias("kind"), null("binary").alias("tables"))
    for keys, kind in ((forced, FORCED), (gone, GONE)):
        if keys is not None:
            asked = asked.unionByName(keys.select(part, null("bigint").alias("row_id"), "key", null("bigint").alias("arrival"), F.xxhash64("key").alias("h"), F.lit(False).alias("wanted"), F.lit(kind).alias("kind"), null("binary").alias("tables")))
    if tables is not None:
        empty = {"row_id": "bigint", "key": "binary", "arrival": "bigint", "h": "bigint"}
        asked = asked.unionByName(tables.where(F.col("tables").isNotNull()).select("part", *(null(t).alias(c) for c, t in empty.items()), F.lit(False).alias("wanted"), F.lit(STORED).alias("kind"), "tables"))
    ordered = asked.repartition("part").sortWithinPartitions("part", "kind", "arrival", "h")
    return ordered.mapInArrow(_pass(keep, buckets), _OUT_DDL)


class SeenKeys:
    """Keys told as seen before or new, batch by batch, with the cuckoo tables and a log of the keys on shared storage.

    Every key goes through the tables. Of a key that more than a hundredth of a batch's rows have (at most a hundred keys) one row goes, its
    first, as the table affirms the later ones for certain. Only what the tables affirm is looked up in the log, which thus is read by
    the affirmed keys' hashes only. A new key that the tables affirmed by chance has no fingerprint of its own; it is added with
    the next batch, so that taking it out later takes no other key's.

    The log is one row per key, arrival and batch; a key that was taken out is new when it comes again.
    """

    def __init__(self, spark: SparkSession, parts: int = 32, buckets: int = 1024, path: str | None = None):
        self.spark, self.parts, self.buckets, self.path = spark, parts, buckets, path or shared_path(spark, "seen")
        self.turn, self.state, self.fix = 0, None, None

    def _log(self, turns: range) -> DataFrame:
        schema = "h bigint, key binary, first bigint, gone boolean"
        read = [self.spark.read.schema(schema).parquet(f"{self.path}/log/{k}").withColumn("turn", F.lit(k)) for k in turns]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema + ", turn int")

    def _first(self, keys: DataFrame) -> DataFrame:
        """h, key, first: the first arrival of each key whose hash is among keys (h), since it was last taken out."""
        rows = self._log(range(1, self.turn + 1)).join(keys.select("h").distinct(), "h", "left_semi")
        # one row a key and batch; of these, those since the last removal
        by = rows.groupBy("h", "key").agg(F.max(F.when(F.col("gone"), F.col("turn"))).alias("end"), F.min("first").alias("least"), F.collect_list(F.when(~F.col("gone"), F.struct("turn", "first"))).alias("all"))
        since = F.array_min(F.transform(F.filter("all", lambda x: x["turn"] >= F.col("end")), lambda x: x["first"]))
        return by.select("h", "key", F.when(F.col("end").isNull(), F.col("least")).otherwise(since).alias("first")).where("first is not null")

    def take(self, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """row_id, flagged, repeat of each wanted row whose key the tables affirm or that has a hot key; all others are certainly new.

        rows: row_id, key, arrival, wanted; those with a null key or arrival have no answer. A row is a repeat if its key stands in any row
        with a smaller arrival, of this batch or an earlier one; a row sent twice (same arrival) is none for that. flagged: whether
        the tables affirm it. gone: keys (key) to be taken out before; those that never came are passed over.
        """
        rows = rows.select("row_id", F.col("key").cast("binary").alias("key"), "arrival", "wanted").where(F.col("key").isNotNull() & F.col("arrival").isNotNull()).withColumn("h", F.xxhash64("key"))
        if gone is not None:
            gone = gone.where(F.col("key").isNotNull()).select(F.col("key").cast("binary").alias("key"), F.xxhash64("key").alias("h")).distinct()
            gone = written(gone.join(self._first(gone), ["h", "key"], "left_semi"), "gone")
        self.turn += 1
        hot = hot_keys(rows, "h")
        is_hot: Column = F.col("h").isin(hot) if hot else F.lit(False)
        log = rows.groupBy("h", "key").agg(F.min("arrival").alias("first")).withColumn("gone", F.lit(False))
        if gone is not None:
            log = log.unionByName(gone.select("h", "key", F.lit(None).cast("bigint").alias("first"), F.lit(True).alias("gone")))
        log.write.option("compression", "zstd").parquet(f"{self.path}/log/{self.turn}")
        now = self._log(range(self.turn, self.turn + 1)).where("not gone")
        asked = rows.where(~is_hot).select("row_id", "key", "arrival", "wanted")
        if hot:
            asked = asked.unionByName(now.where(is_hot).select(F.lit(None).cast("bigint").alias("row_id"), "key", F.col("first").alias("arrival"), F.lit(False).alias("wanted")))
        out = written(cuckoo_pass(asked, self.parts, self.state, True, self.buckets, self.fix, gone), "cuckoo")
        self.state = out.where("tables is not null").select("part", "tables")
        flagged = out.where("tables is null")
        first = written(self._first(flagged.select("h")), "first")
        told = flagged.join(first, ["h", "key"]).select("row_id", "key", "h", "wanted", (F.col("arrival") > F.col("first")).alias("repeat"))
        self.fix = written(told.where("not repeat").select("key").distinct(), "fix")
        answer = told.where("wanted and row_id is not null").select("row_id", F.lit(True).alias("flagged"), "repeat")
        if hot:
            # at most a hundred rows: the hot keys' first arrivals of all and of this batch, and whether the tables affirmed the latter
            top = now.where(is_hot).withColumnRenamed("first", "mine").join(first.select("h", "key", "first"), ["h", "key"], "left")
            top = top.join(told.where("row_id is null").select("h", "key", F.lit(True).alias("hit")).distinct(), ["h", "key"], "left")
            mine = rows.where(is_hot & F.col("wanted")).join(F.broadcast(top.select("h", "key", "mine", "first", "hit")), ["h", "key"])
            # where the table denied a hot key's first row, that is the first of all
            repeat = F.col("arrival") > F.coalesce("first", "mine")
            hit = (F.col("arrival") > F.col("mine")) | F.coalesce("hit", F.lit(False))
            answer = answer.unionByName(mine.select("row_id", hit.alias("flagged"), repeat.alias("repeat")))
        return answer


def seen_before(rows: DataFrame, parts: int = 32) -> DataFrame:
    """``SeenKeys.take`` of rows as one batch."""
    return SeenKeys(rows.sparkSession, parts).take(rows)
