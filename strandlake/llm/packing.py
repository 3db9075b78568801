"""Filling fixed-capacity containers with items: minimum bin slack over the histogram of sizes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.runtime import written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items of one size that one task numbers.
RANK_ROWS = 500_000

_SIZES_DDL = "doc_id bigint, tokens int"


def _counts(vocabulary: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        enc = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return run


def token_counts(docs: DataFrame, ranks_path: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, tokens of each document (doc_id, text), by a byte-level tokenizer read from a file; 0 for null and empty texts.

    The file (about a megabyte) is read by the driver and sent with the function, so executors need no copy of it.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with open(ranks_path, "rb") as f:
        return rows.mapInArrow(_counts(f.read(), pattern), _SIZES_DDL)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sizes, each as often as available at most, whose sum comes closest to ``room`` from below.

    Subset sums as the bits of one integer: adding k items of a size is a shift by k times the size; counts are split into powers of two,
    and the bits before each step tell afterwards which steps the best sum took.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= room), reverse=True):
        left, k = min(counts[size], room // size), 1
        while left:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            at -= size * k
            out[size] = out.get(size, 0) + k
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers as (how many of this kind, size -> items of it in each): minimum bin slack, the largest item left first in each.

    Items of one size are alike, so a combination is taken as often as the counts allow, and the work depends on the number of
    different sizes (at most the capacity), not on the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must be from 1 to the capacity")
    out = []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        kind = fullest(rest, capacity - top)
        kind[top] = kind.get(top, 0) + 1
        times = min(left[s] // k for s, k in kind.items())
        out.append((times, kind))
        for s, k in kind.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return out


_PACKED_DDL = "doc_id bigint, part_no int, token_start bigint, tokens int, container_no bigint, unused int"


def _assign(kinds: list[tuple[int, dict[int, int]]], capacity: int):
    # per size: ranks from which a kind serves, its first container, its items of that size and its unused space
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, kind in kinds:
        unused = capacity - sum(s * k for s, k in kind.items())
        for s, k in kind.items():
            by_size.setdefault(s, []).append((taken.get(s, 0), first, k, unused))
            taken[s] = taken.get(s, 0) + times * k
        first += times
    table = {s: np.array(x, np.int64).T for s, x in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
            box, unused = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            for s in np.unique(size):
                me = np.flatnonzero(size == s)
                start, begin, each, free = table[int(s)]
                k = np.searchsorted(start, rank[me], "right") - 1
                box[me] = begin[k] + (rank[me] - start[k]) // each[k]
                unused[me] = free[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part_no"), b.column("token_start"), b.column("tokens"), pa.array(box), pa.array(unused)], names=["doc_id", "part_no", "token_start", "tokens", "container_no", "unused"])

    return run


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, part_no, token_start, tokens, container_no, unused: a container for each item (doc_id, tokens), and the space left in it.

    Items over the capacity are split into parts of the capacity and a rest, others never. Items without tokens (null counts as none) take
    no space: container_no and unused are null. Rows sent twice count once. Containers are numbered from 0.

    The driver sees the histogram of sizes only (at most ``capacity`` rows), and plans with it; the items of one size are numbered
    across tasks, in blocks of RANK_ROWS, and a number tells the container.
    """
    n = F.coalesce(F.col("tokens"), F.lit(0))
    parts = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    items = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.cast("bigint").alias("n"), F.explode(parts).alias("part_no"))
    items = items.select("doc_id", "part_no", (F.col("part_no") * F.lit(capacity).cast("bigint")).alias("token_start"), F.least(F.col("n") - F.col("part_no") * capacity, F.lit(capacity)).cast("int").alias("tokens")).distinct()
    items = written(items, "sizes")
    full = items.where("tokens > 0")
    histogram = {r["tokens"]: r["n"] for r in full.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = {s: -(-n // RANK_ROWS) for s, n in histogram.items() if n > RANK_ROWS}
    block = F.lit(0)
    if split:
        block = F.coalesce(F.pmod(F.xxhash64("doc_id", "part_no"), F.element_at(F.create_map(*(F.lit(x) for p in split.items() for x in p)), F.col("tokens"))), F.lit(0))
    full = full.withColumn("block", block.cast("int"))
    before = full.groupBy("tokens", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("tokens", "block", (F.sum("n").over(W.partitionBy("tokens").orderBy("block")) - F.col("n")).alias("before"))
    mine = F.row_number().over(W.partitionBy("tokens", "block").orderBy("doc_id", "part_no"))
    ranked = full.withColumn("mine", mine).join(before, ["tokens", "block"])
    ranked = ranked.select("doc_id", "part_no", "token_start", "tokens", (F.col("before") + F.col("mine") - 1).cast("bigint").alias("rank"))
    packed = ranked.mapInArrow(_assign(plan(histogram, capacity), capacity), _PACKED_DDL)
    empty = items.where("tokens = 0").select("doc_id", "part_no", "token_start", "tokens", F.lit(None).cast("bigint").alias("container_no"), F.lit(None).cast("int").alias("unused"))
    return packed.unionByName(empty)
