"""Near-duplicate records with small edits: a forest of signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.letters import Letters, distinct
from strandlake.runtime import HOT_SHARE, hot_keys, skew_safe_join, written

GRAM = 12
LEAST = 30
#: Bits of a token bitmap.
BITS = 2048
#: A pair at the very similarity of 0.5 shares no tree with this probability at most.
MISSED = 1e-6
#: Up to so many trees of two or more (16 MB) texts are filtered by them where they are read; beyond, by the join alone.
FILTER_LIMIT = 2_000_000
#: Records under a leaf, and under a block: the largest part of a tree that one task walks.
LEAF, BLOCK = 8, 1024
SEED = 20_011
CACHED = 400


def bands_for(texts: int) -> tuple[int, int]:
    """Minwise values of a band, and bands, for so many different texts.

    Texts that overlap in part share single values often, so there are two at least. Texts that have nothing to do with each other share
    them by chance, one in 4**(GRAM * values); so there are as many as keep those to a block. The number of bands then follows from
    MISSED, which holds at every size.
    """
    rows = 2
    while texts > BLOCK * 4 ** (GRAM * rows):
        rows += 1
    return rows, int(np.ceil(np.log(MISSED) / np.log(1 - 0.5**rows)))


def prepared(seq: str) -> F.Column:
    return F.upper(F.regexp_replace(seq, "\r+$", ""))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of each text: row of each, code of each, count by row; sorted by row."""
    t = Letters(texts)
    code, ok = t.grams(GRAM)
    at = np.flatnonzero(ok)
    row = t.row_of(at)
    both = distinct((row.astype(np.uint64) << np.uint64(2 * GRAM)) | code[at])
    row = (both >> np.uint64(2 * GRAM)).astype(np.int64)
    return row, both & np.uint64((1 << 2 * GRAM) - 1), np.bincount(row, minlength=len(texts))


def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(1 << 61, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


_BANDED_DDL = "rep bigint, keys array<bigint>"
_BANDED = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sketchable(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts with enough tokens: their numbers, their tokens' hashes in a row, where each one's begin, and how many it has."""
    row, code, count = _tokens(t.column("seq"))
    fit = np.flatnonzero(count >= LEAST)
    size = count[fit]
    return fit, Letters.mix(code[count[row] >= LEAST] + np.uint64(1)), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size


def _listed(b: pa.RecordBatch, fit: np.ndarray, keys: np.ndarray, sizes: np.ndarray, wanted: np.ndarray | None) -> pa.RecordBatch:
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
        ok = wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ok], minlength=len(sizes))
        keys = keys[ok]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(fit)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))], schema=_BANDED)


def _band_keys(rows: int, bands: int, wanted: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each product gives two hash values, of its upper and its lower half
        need = -(-rows * bands // 2)
        factor = _factors(need)
        for b in batches:
            fit, base, start, _ = _sketchable(b)
            if not len(fit):
                continue
            least = np.empty((2 * need, len(fit)), np.uint64)
            # some texts at a time, whose tokens fit into a processor's cache
            for at in range(0, len(fit), CACHED):
                first = start[at : at + CACHED]
                some = base[first[0] : start[at + CACHED] if at + CACHED < len(fit) else len(base)]
                for k in range(need):
                    product = some * factor[k]
                    least[2 * k, at : at + CACHED] = np.minimum.reduceat((product >> np.uint64(32)).astype(np.uint32), first - first[0])
                    least[2 * k + 1, at : at + CACHED] = np.minimum.reduceat(product.astype(np.uint32), first - first[0])
            keys = np.zeros((len(fit), bands), np.uint64)
            for k in range(bands):
                for m in least[k * rows : (k + 1) * rows]:
                    keys[:, k] = Letters.mix(keys[:, k] * np.uint64(0x100000001B3) + m)
                keys[:, k] = Letters.mix(keys[:, k] + np.uint64(k))
            yield _listed(b, fit, keys.ravel(), np.full(len(fit), bands), wanted)

    return run


def _prefix_keys(wanted: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n - ceil(n / 2) + 1 tokens with the smallest hashes of each text of n: similar texts have one of these in common, without exception."""
        for b in batches:
            fit, base, start, size = _sketchable(b)
            if not len(fit):
                continue
            own = np.repeat(np.arange(len(fit)), size)
            base = base[np.lexsort((base, own))]
            keep = np.arange(len(base)) - np.repeat(start, size) <= np.repeat(size // 2, size)
            yield _listed(b, fit, base[keep], size // 2 + 1, wanted)

    return run


class _Node:
    """Records of a tree: token bitmaps, sizes; or nodes over them: OR of the bitmaps and range of the sizes."""

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, extra: np.ndarray):
        self.bits, self.low, self.high, self.extra = bits, low, high, extra

    def above(self, width: int) -> _Node:
        at = np.arange(0, len(self.low), width)
        return _Node(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.extra, at))

    def may_meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether some record under i and some under j can have 2|a & b| >= |a | b|.

        Common tokens are at most the common bits, plus the tokens that share a bit with another of their record. The sizes allow it
        only if the larger is at most twice the smaller.
        """
        most = np.bitwise_count(self.bits[i] & self.bits[j]).sum(1, dtype=np.int64) + np.minimum(self.extra[i], self.extra[j])
        most = np.minimum(most, np.minimum(self.high[i], self.high[j]))
        return (3 * most >= self.low[i] + self.low[j]) & (2 * self.high[i] >= self.low[j]) & (2 * self.high[j] >= self.low[i])


def _pairs_within(a: int, b: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(a, 1) if same else tuple(x.ravel() for x in np.indices((a, b)))


def _bitmaps(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bitmap of each text's tokens, and the number of bits set."""
    bits = np.zeros((n, BITS), bool)
    bits[row, (Letters.mix(code + np.uint64(1)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64), bits.sum(1, dtype=np.int64)


def _meet(one: _Node, other: _Node, i: np.ndarray, j: np.ndarray, step: int = 50_000) -> np.ndarray:
    """may_meet of nodes i of one and j of other, some at a time."""
    both = _Node(*(np.concatenate([getattr(one, k), getattr(other, k)]) for k in ("bits", "low", "high", "extra")))
    return np.concatenate([both.may_meet(i[k : k + step], j[k : k + step] + len(one.low)) for k in range(0, len(i), step)]) if len(i) else np.zeros(0, bool)


def tree_pairs(texts: pa.Array, groups: list[tuple[int, int, int]], tally: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, common tokens and union sizes of all similar pairs in each group of neighbouring rows.

    groups: (start, middle, end); pairs are sought between the rows before and after middle, or within all rows where middle is end.
    Each group is a signature tree that is walked from both sides at once: pairs of leaves whose bitmaps and sizes admit no similar
    pair are dropped with all records under them, then pairs of a record and a leaf, then pairs of records; what is left is counted
    exactly. Like texts stand side by side (by their smallest token hash), so that leaves are of like sets. tally: a dict that gets the
    pairs that were looked at and those that were kept, by level.
    """
    row, code, size = _tokens(texts)
    n = len(texts)
    packed, ones = _bitmaps(row, code, n)
    records = _Node(packed, size, size, size - ones)
    lead = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(lead, row, Letters.mix(code + np.uint64(7)))

    def count(level: str, ok: np.ndarray) -> None:
        if tally is not None:
            was = tally.setdefault(level, [0, 0])
            was[0], was[1] = was[0] + len(ok), was[1] + int(ok.sum())

    left, right = [], []
    for start, middle, end in groups:
        same = middle == end
        side = lambda lo, hi: lo + np.lexsort((size[lo:hi], lead[lo:hi]))
        mine = side(start, middle)
        theirs = mine if same else side(middle, end)
        if len(mine) <= LEAF and len(theirs) <= LEAF:
            i, j = _pairs_within(len(mine), len(theirs), same)
            left.append(mine[i])
            right.append(theirs[j])
            continue
        under = [_Node(packed[x], size[x], size[x], records.extra[x]) for x in (mine, theirs)]
        a, b = (x.above(LEAF) for x in under)
        i, j = np.triu_indices(len(a.low)) if same else _pairs_within(len(a.low), len(b.low), False)
        ok = _meet(a, b, i, j)
        count("leaves", ok)
        i, j = i[ok], j[ok]
        # a record of the one leaf with the other leaf
        r = (i[:, None] * LEAF + np.arange(LEAF)).ravel()
        j = np.repeat(j, LEAF)
        inside = r < len(mine)
        r, j = r[inside], j[inside]
        ok = _meet(under[0], b, r, j)
        count("record and leaf", ok)
        r, j = r[ok], j[ok]
        t = (j[:, None] * LEAF + np.arange(LEAF)).ravel()
        r = np.repeat(r, LEAF)
        inside = (t < len(theirs)) & ((r < t) if same else True)
        left.append(mine[r[inside]])
        right.append(theirs[t[inside]])
    none = np.zeros(0, np.int64)
    if not left:
        return none, none, none, none
    i, j = np.concatenate(left), np.concatenate(right)
    ok = _meet(records, records, i, j) & (size[np.minimum(i, j)] > 0)
    count("records", ok)
    i, j = i[ok], j[ok]
    # the exact count: which of a text's tokens the other has, looked up in all tokens in order
    have, first = (row.astype(np.uint64) << np.uint64(2 * GRAM)) | code, np.r_[0, np.cumsum(size)]
    common = np.zeros(len(i), np.int64)
    for k in range(0, len(i), 20_000):
        p, q = i[k : k + 20_000], j[k : k + 20_000]
        whose = np.repeat(np.arange(len(p)), size[p])
        at = np.arange(len(whose)) - np.repeat(np.cumsum(size[p]) - size[p], size[p]) + first[p][whose]
        ask = (q[whose].astype(np.uint64) << np.uint64(2 * GRAM)) | code[at]
        place = np.minimum(np.searchsorted(have, ask), len(have) - 1)
        common[k : k + len(p)] = np.bincount(whose[have[place] == ask], minlength=len(p))
    union = size[i] + size[j] - common
    ok = 2 * common >= union
    return i[ok], j[ok], common[ok], union[ok]


_PAIR_DDL = "rep_a bigint, rep_b bigint, common int, either int"
_PAIR = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64()), ("common", pa.int32()), ("either", pa.int32())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by task, in a task by side: the similar pairs of each task."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        task, side, rep = (t.column(c).to_numpy() for c in ("task", "side", "rep"))
        cuts = np.r_[0, np.flatnonzero(task[1:] != task[:-1]) + 1, len(task)]
        groups = []
        for s, e in zip(cuts, cuts[1:]):
            middle = s + int((side[s:e] == 0).sum())
            groups.append((int(s), int(middle), int(e)))
        i, j, common, either = tree_pairs(t.column("seq").combine_chunks(), groups)
        if len(i):
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(common.astype(np.int32)), pa.array(either.astype(np.int32))], schema=_PAIR)

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        rest.append(b)
        t = pa.Table.from_batches(rest)
        task = t.column("task").to_numpy()
        change = np.flatnonzero(task[1:] != task[:-1])
        whole = int(change[-1]) + 1 if len(change) else 0
        if whole:
            yield from done(t.slice(0, whole))
            rest = t.slice(whole).to_batches()
    if rest:
        yield from done(pa.Table.from_batches(rest))


_SUMMARY_DDL = "tree bigint, block int, bits binary, low int, high int, extra int"
_SUMMARY = pa.schema([("tree", pa.int64()), ("block", pa.int32()), ("bits", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("extra", pa.int32())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial summaries of blocks: OR of bitmaps and ranges of sizes of the rows of a batch."""
    for b in batches:
        if not len(b):
            continue
        row, code, size = _tokens(b.column("seq"))
        packed, ones = _bitmaps(row, code, len(b))
        extra = size - ones
        tree, block = b.column("tree").to_numpy(), b.column("block").to_numpy()
        order = np.lexsort((block, tree))
        t, k = tree[order], block[order]
        at = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1]
        ored = np.bitwise_or.reduceat(packed[order], at)
        low, high, more = (f.reduceat(x[order], at).astype(np.int32) for f, x in ((np.minimum, size), (np.maximum, size), (np.maximum, extra)))
        yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(k[at]), pa.array([x.tobytes() for x in ored], pa.binary()), pa.array(low), pa.array(high), pa.array(more)], schema=_SUMMARY)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        bits = np.frombuffer(b"".join(b.column("bits_a").to_pylist() + b.column("bits_b").to_pylist()), np.uint64).reshape(2 * len(b), -1)
        both = lambda c: np.r_[b.column(c + "_a").to_numpy(), b.column(c + "_b").to_numpy()].astype(np.int64)
        ok = _Node(bits, both("low"), both("high"), both("extra")).may_meet(np.arange(len(b)), len(b) + np.arange(len(b)))
        yield b.filter(pa.array(ok)).select(["tree", "block_a", "block_b"])


def classes(records: DataFrame) -> DataFrame:
    """rep, seq: each distinct text with the smallest record number that has it. Null texts and numbers are left out."""
    rows = records.select(F.col("rec_no").cast("bigint").alias("rec_no"), prepared("seq").alias("seq")).where(F.col("rec_no").isNotNull() & (F.length("seq") >= GRAM + LEAST - 1))
    return rows.groupBy("seq").agg(F.min("rec_no").alias("rep")).select("rep", "seq")


def members(records: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, rec_no of all records of the classes; a class of many copies is spread over tasks."""
    rows = records.select(F.col("rec_no").cast("bigint").alias("rec_no"), prepared("seq").alias("seq")).where(F.col("rec_no").isNotNull() & (F.length("seq") >= GRAM + LEAST - 1))
    rows = rows.select("rec_no", "seq", F.xxhash64("seq").alias("h"))
    joined = skew_safe_join(rows, reps.withColumn("h", F.xxhash64("seq")), ["h", "seq"], "inner", hot_keys(rows, "h"))
    return joined.select("rep", "rec_no").distinct()


def similar_classes(reps: DataFrame, exact: bool = False) -> DataFrame:
    """rep_a, rep_b, common, either (sizes of intersection and union) of all pairs of different texts with 2 common >= either.

    Texts (rep, seq) are read as sets of their distinct 12-letter substrings of A, C, G and T; those with fewer than 30 take no part.
    A forest keeps unlike texts apart: each band of minwise values names a tree (bands_for), and each tree's texts are walked from both
    sides (tree_pairs), in blocks of BLOCK texts whose pairs are pruned in the same way. Trees of one text are dropped, equal trees walked
    once. A pair at the threshold has no tree in common with probability MISSED, one above it far less; with ``exact``, trees are named by
    tokens instead (_prefix_keys) and none is missed, for two to three times the rows.
    """
    form = (lambda wanted: _prefix_keys(wanted)) if exact else partial(_band_keys, *bands_for(reps.count()))
    named = lambda wanted: reps.mapInArrow(form(wanted), _BANDED_DDL).select(F.explode("keys").alias("tree"), "rep")
    sizes = written(named(None).groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    some = sizes.select("tree").limit(FILTER_LIMIT + 1).toArrow().column("tree").to_numpy()
    if len(some) <= FILTER_LIMIT:
        # few trees of two or more: the texts name their trees once more, and only these are rows
        under = named(np.sort(some.view(np.uint64))).join(sizes, "tree")
    else:
        total = sizes.agg(F.sum("n")).first()[0]
        hot = [r["tree"] for r in sizes.where(F.col("n") > HOT_SHARE * total).collect()]  # 1 / HOT_SHARE rows at most
        under = skew_safe_join(named(None), sizes, ["tree"], "inner", hot)
    under = written(under, "trees")
    # small trees: the list of texts is the tree, and bands with the same list are walked once
    small = under.where(F.col("n") <= BLOCK).groupBy("tree").agg(F.array_sort(F.collect_list("rep")).alias("all"))
    small = small.select("all").distinct().select(F.xxhash64("all").alias("task"), F.explode("all").alias("rep"), F.lit(0).alias("side"))
    # large trees: blocks, and the pairs of blocks that may meet
    blocks = F.ceil(F.col("n") / BLOCK)
    large = under.where(F.col("n") > BLOCK).select("tree", "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    with_text = large.join(reps, "rep").select("tree", "block", "seq")
    # partial summaries by task; a block's few are merged by a second pass over them
    part = with_text.mapInArrow(_summaries, _SUMMARY_DDL).groupBy("tree", "block")
    ored = part.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("extra").alias("extra"), F.collect_list("bits").alias("all"))
    word = lambda i: F.expr(f"aggregate(transform(all, x -> conv(hex(substring(x, {8 * i + 1}, 8)), 16, -10)), 0L, (a, x) -> a | cast(x as bigint))")
    ored = ored.select("tree", "block", "low", "high", "extra", F.unhex(F.concat(*(F.lpad(F.hex(word(i)), 16, "0") for i in range(BITS // 64)))).alias("bits"))
    side = lambda s: ored.select("tree", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "bits", "low", "high", "extra")))
    meet = side("a").join(side("b"), "tree").where("block_a <= block_b").mapInArrow(_block_pairs, "tree bigint, block_a int, block_b int")
    task = F.xxhash64("tree", "block_a", "block_b")
    ends = meet.select("tree", task.alias("task"), F.explode(F.when(F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side"))))).alias("x"))
    big = ends.select("tree", "task", "x.block", "x.side").join(large, ["tree", "block"]).select("task", "rep", "side")
    walks = small.unionByName(big).join(reps, "rep").select("task", "side", "rep", "seq")
    ordered = walks.repartition("task").sortWithinPartitions("task", "side")
    return ordered.mapInArrow(_walk, _PAIR_DDL).distinct()


def similar_records(records: DataFrame, exact: bool = False) -> DataFrame:
    """rec_a, rec_b (rec_a < rec_b) of all pairs of records (rec_no, seq) with similar or equal texts; see similar_classes."""
    reps = written(classes(records), "classes")
    pairs = similar_classes(reps, exact)
    who = written(members(records, reps), "members")
    a, b = who.select(F.col("rep").alias("rep_a"), F.col("rec_no").alias("x")), who.select(F.col("rep").alias("rep_b"), F.col("rec_no").alias("y"))
    apart = pairs.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    # copies of one text: pairs with themselves, if the text counts at all
    several = who.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    counts = reps.join(several, "rep").mapInArrow(_band_keys(1, 1), _BANDED_DDL).select("rep")
    copies = who.join(counts, "rep")
    equal = copies.select("rep", F.col("rec_no").alias("x")).join(copies.select("rep", F.col("rec_no").alias("y")), "rep").where("x < y").select("x", "y")
    return apart.unionByName(equal).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def linked_groups(records: DataFrame) -> DataFrame:
    """rec_no, class_id, links, group_id of each record: the smallest number with the same text, the number of other texts that its text is
    similar to, and the smallest number of all that chains of such links reach. Records that take no part have their own number."""
    reps = written(classes(records), "classes")
    pairs = written(similar_classes(reps).select("rep_a", "rep_b"), "links")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    label = components(pairs.withColumnsRenamed({"rep_a": "a", "rep_b": "b"}))
    who = members(records, reps)
    own = records.select(F.col("rec_no").cast("bigint").alias("rec_no")).where("rec_no is not null").distinct()
    out = own.join(who, "rec_no", "left").withColumn("rep", F.coalesce("rep", "rec_no")).join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("rec_no", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("label", "rep").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, for edges (a, b). Labels spread to neighbours and are followed to their own label
    in each round, so rounds grow as the logarithm of the longest chain; each round is a table on shared storage."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if step.where("old <> label").isEmpty():
            return step.select("node", "label")
        label = step.select("node", "label")
