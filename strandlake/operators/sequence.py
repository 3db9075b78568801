"""DNA sequences: k-mers, seeds, runs, transforms, matches and edit scripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.runtime import written


def kmers(rows: DataFrame, key: list[str], seq: str, k: int, stride: int = 1, reach: int | None = None) -> DataFrame:
    """key, pos (from 0), kmer: all substrings of k letters that are A, C, G or T, at every ``stride``-th place; with reach, also ``tail``, the ``reach`` letters from there, fewer at the end."""
    starts = F.sequence(F.lit(0), F.length(seq) - k, F.lit(stride))
    each = rows.where(F.length(seq) >= k).select(*key, seq, F.explode(starts).alias("pos"))
    tail = [F.expr(f"substring({seq}, pos + 1, {reach})").alias("tail")] if reach else []
    return each.select(*key, "pos", F.expr(f"substring({seq}, pos + 1, {k})").alias("kmer"), *tail).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))


def kmer_counts(rows: DataFrame, seq: str, k: int) -> DataFrame:
    return kmers(rows, [], seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def seed_cap(bases: int) -> int:
    return min((bases >> 20) + 2, 500)


def seed_index(fragments: DataFrame, cap: int, k: int = 10, stride: int = 64, reach: int | None = None) -> DataFrame:
    """kmer, ref_seq_no, pos, with reach also tail: at most the first ``cap`` places of each k-mer (a feature of the index). The rank limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy("kmer").orderBy("ref_seq_no", "pos"))
    return kmers(fragments, ["ref_seq_no"], "bases", k, stride, reach).withColumn("r", rank).where(F.col("r") <= cap).drop("r")


def first_seed_hits(reads: DataFrame, rec: str, seq: str, seeds: DataFrame, verify: int = 16, k: int = 10, mismatches: int = 0) -> DataFrame:
    """rec, pos, ref_seq_no, ref_pos: each read's first place whose k-mer is a seed and whose next letters up to ``verify`` fit the reference.

    seeds: seed_index with reach ``verify``, so that a hit is judged by its own row and neither read nor reference is carried along. At most
    ``mismatches`` of the letters behind the k-mer may differ. Places too near an end for ``verify`` letters do not count.
    """
    mine = kmers(reads, [rec], seq, k, 1, verify).where(F.length("tail") == verify)
    hits = mine.join(seeds.where(F.length("tail") == verify).withColumnsRenamed({"pos": "ref_pos", "tail": "ref_tail"}), "kmer")
    letters = lambda c: F.split(F.substring(c, k + 1, verify - k), "")
    fits = F.col("tail") == F.col("ref_tail")
    if mismatches:
        wrong = F.size(F.filter(F.zip_with(letters("tail"), letters("ref_tail"), lambda x, y: x != y), lambda x: x))
        fits = fits | (wrong <= mismatches)
    best = F.min(F.struct("pos", "ref_seq_no", "ref_pos"))
    return hits.where(fits).groupBy(rec).agg(best.alias("__b")).select(rec, "__b.pos", "__b.ref_seq_no", "__b.ref_pos")


#: Letters by which a table of first places is at most kept; a bit for each text of so many letters is 8 MB.
KEPT = 13
#: Letters of the reference taken at a time.
TAKEN = 1 << 22
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _joined(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of all texts (4: not A, C, G, T), a 4 behind each and ``end`` more at the end; where each begins."""
    codes = _CODES[np.frombuffer(("\n".join(texts) + "\n" * (end + 1)).encode("latin-1", "replace"), np.uint8)]
    return codes, np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]


def _codes(letters: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    """The k letters from each place as a number, -1 where not all are A, C, G, T. at: places, or a slice of all."""
    n = len(letters) - k + 1
    out, other = np.int32(0), False
    for i in range(k):
        x = letters[i : i + n][at] if isinstance(at, slice) else letters[at + i]
        out, other = out * np.int32(4) + (x & 3), other | (x > 3)
    return np.where(other, np.int32(-1), out)


def _first(key: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first ``most`` of their key; key is sorted."""
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(begins, np.diff(np.r_[begins, len(key)])) < most


def first_places(fragments: DataFrame, cap: int, k: int = 10, stride: int = 8, verify: int = 12) -> DataFrame:
    """code, place: each text of ``verify`` letters that begins with a seed (the places of seed_index), with its first place, ref_seq_no << 32 | pos.

    Places go as arrays, grouped by the beginning of their k-mer, so that a place is a few bytes and no row. The cap is applied before the shuffle too.
    """
    more = verify - k
    scale, shift = np.int32(4**more + 1), max(0, 2 * k - 12)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nos, sizes, i = b.column("ref_seq_no").to_pylist(), pc.utf8_length(b.column("bases")).to_pylist(), 0
            while i < len(nos):
                n, size = i, 0
                while n < len(nos) and (n == i or size + sizes[n] <= TAKEN):
                    size, n = size + sizes[n], n + 1
                letters, begins = _joined(b.column("bases").slice(i, n - i).to_pylist(), verify)
                count = np.maximum((np.array(sizes[i:n]) - k) // stride + 1, 0)
                which = np.repeat(np.arange(n - i), count)
                pos = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * stride
                kmer, rest = _codes(letters, begins[which] + pos, k), _codes(letters, begins[which] + pos + k, more) if more else np.int32(0)
                # a number for the k-mer and, from 1 on, for the letters behind it; 0 where these are not there
                key, place = kmer * scale + rest + np.int32(1), np.array(nos[i:n], np.int64)[which] << 32 | pos
                order = np.lexsort((place, kmer))
                order = order[_first(kmer[order], cap)]
                order = order[kmer[order] >= 0]
                key, place, bucket = key[order], place[order], kmer[order] >> shift
                edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else [0]
                blobs = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), blobs(key), blobs(place)], names=["bucket", "keys", "places"])
                i = n

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = [], []
        for b in batches:
            keys += b.column("keys").to_pylist()
            places += b.column("places").to_pylist()
        key, place = np.frombuffer(b"".join(keys), np.int32), np.frombuffer(b"".join(places), np.int64)
        order = np.lexsort((place, key // scale))
        order = order[_first(key[order] // scale, cap)]
        key, place = key[order], place[order]
        order = np.lexsort((place, key))
        order = order[_first(key[order], 1) & (key[order] % scale > 0)]
        key, place = key[order], place[order]
        code = (key // scale << 2 * more) + key % scale - 1
        for i in range(0, len(code), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 18)], pa.int32()), pa.array(place[i : i + (1 << 18)], pa.int64())], names=["code", "place"])

    rows = fragments.select("ref_seq_no", "bases").where(F.length("bases") >= k).mapInArrow(cut, "bucket int, keys binary, places binary")
    return rows.repartition("bucket").mapInArrow(pick, "code int, place bigint")


def first_hits(reads: DataFrame, rec: str, seq: str, fragments: DataFrame, cap: int, k: int = 10, stride: int = 8, verify: int = 12) -> DataFrame:
    """What first_seed_hits finds with the seeds of ``fragments`` (of A, C, G and T), without mismatches and for distinct ``rec``; a read is a row and not one a k-mer.

    A hit depends on the ``verify`` letters alone. So one place is kept of each text of so many letters (first_places), and a bit for each such
    text, 2 MB for 12 letters, tells where in a read the first is that has a place. These passes run while the query is built.
    """
    if verify > KEPT:
        return first_seed_hits(reads, rec, seq, seed_index(fragments, cap, k, stride, verify), verify, k)
    places = written(first_places(fragments, cap, k, stride, verify), "places")
    one = F.col("code") + 1
    words = places.groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("w")).collect()
    known = np.zeros(max(1, 4**verify // 32_768) * 4096, np.uint8)
    for r in words:
        known[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["w"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(seq).is_valid())
            letters, begins = _joined(b.column(seq).to_pylist(), verify)
            code = _codes(letters, slice(None), verify)
            at = np.flatnonzero((code >= 0) & (known[code >> 3] >> (code & 7) & 1).astype(bool))
            row, first = np.unique(np.searchsorted(begins, at, "right") - 1, return_index=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays([b.column(rec).take(pa.array(row)), pa.array(at - begins[row], pa.int32()), pa.array(code[at], pa.int32())], names=[rec, "pos", "code"])

    hits = reads.select(rec, seq).mapInArrow(run, f"`{rec}` {reads.schema[rec].dataType.simpleString()}, pos int, code int")
    return hits.join(places, "code").select(rec, "pos", F.shiftright("place", 32).cast("int").alias("ref_seq_no"), F.expr("cast(place & 4294967295 as int)").alias("ref_pos"))


def n_runs(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, loc, cnt: runs of N; loc counts the other letters before it. From the pieces of one pattern, without a row a letter."""
    parts = F.regexp_extract_all(F.col(seq), F.lit("([^N]*)(N+)"), F.lit(0))
    each = rows.where(F.col(seq).contains("N")).select(key, F.posexplode(F.transform(parts, lambda p: F.struct(F.length(F.regexp_replace(p, "N", "")).alias("o"), F.length(F.regexp_replace(p, "[^N]", "")).alias("c")))).alias("i", "x"))
    loc = F.sum("x.o").over(W.partitionBy(key).orderBy("i"))
    return each.select(key, loc.cast("bigint").alias("loc"), F.col("x.c").cast("bigint").alias("cnt"))


def n_transfer(seq: Column, qual: Column) -> tuple[Column, Column]:
    """The sequence without N, and the qualities with 128 added where it was."""
    moved = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda c, q: F.when(c == "N", F.chr(F.ascii(q) + 128)).otherwise(q))
    return F.regexp_replace(seq, "N", ""), F.when(F.length(qual) > 0, F.array_join(moved, "")).otherwise(qual)


def n_restore(seq: Column, qual: Column) -> tuple[Column, Column]:
    """The inverse of n_transfer."""
    # the place of a letter in the bare sequence is the number of unmarked qualities up to it
    flags = F.transform(F.sequence(F.lit(1), F.length(qual)), lambda i: F.ascii(F.substring(qual, i, F.lit(1))) >= 128)
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    step = lambda a, f: F.struct(F.concat(a["s"], F.when(f, F.lit("N")).otherwise(F.substring(seq, a["n"] + 1, F.lit(1)))).alias("s"), (a["n"] + F.when(f, 0).otherwise(1)).alias("n"))
    whole = F.when(F.length(qual) > 0, F.aggregate(flags, zero, step)["s"]).otherwise(seq)
    plain = F.transform(F.split(qual, ""), lambda q: F.when(F.ascii(q) >= 128, F.chr(F.ascii(q) - 128)).otherwise(q))
    return whole, F.when(F.length(qual) > 0, F.array_join(plain, "")).otherwise(qual)


_CODE = lambda c: F.instr(F.lit("ACGT"), c) - 1


def to_colours(seq: Column) -> Column:
    """First letter and then, for each step, the exclusive or of both letters' codes as a digit. Null for other letters than A, C, G, T."""
    digits = F.zip_with(F.split(F.substring(seq, F.lit(2), F.length(seq)), ""), F.split(F.left(seq, F.length(seq) - 1), ""), lambda x, y: _CODE(x).bitwiseXOR(_CODE(y)).cast("string"))
    return F.when(seq.rlike("^[ACGT]$"), seq).when(seq.rlike("^[ACGT]+$"), F.concat(F.substring(seq, 1, 1), F.array_join(digits, "")))


def from_colours(coded: Column) -> Column:
    """The inverse of to_colours."""
    step = lambda a, d: F.struct(F.concat(a["s"], F.substring(F.lit("ACGT"), a["c"].bitwiseXOR(d) + 1, F.lit(1))).alias("s"), a["c"].bitwiseXOR(d).alias("c"))
    start = F.struct(F.substring(coded, 1, 1).alias("s"), _CODE(F.substring(coded, 1, 1)).alias("c"))
    digits = F.transform(F.sequence(F.lit(2), F.length(coded)), lambda i: F.substring(coded, i, F.lit(1)).cast("int"))
    return F.when(coded.rlike("^[ACGT]$"), coded).when(coded.rlike("^[ACGT][0-3]+$"), F.aggregate(digits, start, step)["s"])


def pack2(seq: Column) -> Column:
    """Four letters a byte; the last byte is filled with A. Null for other letters than A, C, G, T."""
    full = F.concat(seq, F.repeat(F.lit("A"), F.pmod(-F.length(seq), F.lit(4))))
    pair = lambda i: F.hex((_CODE(F.substring(full, 2 * i + 1, F.lit(1))) * 4 + _CODE(F.substring(full, 2 * i + 2, F.lit(1)))).cast("bigint"))
    digits = F.transform(F.sequence(F.lit(0), (F.length(full) / 2 - 1).cast("int")), pair)
    return F.when(seq.rlike("^[ACGT]+$"), F.unhex(F.array_join(digits, ""))).when(seq == "", F.unhex(F.lit("")))


def unpack2(data: Column, n: Column) -> Column:
    """The first n letters of packed bytes."""
    h = F.hex(data)
    pairs = F.transform(F.sequence(F.lit(1), F.length(h)), lambda i: F.substring(F.lit("AAACAGATCACCCGCTGAGCGGGTTATCTGTT"), F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") * 2 + 1, F.lit(2)))
    return F.when(n > 0, F.substring(F.array_join(pairs, ""), F.lit(1), n)).otherwise(F.lit(""))


#: Fixed value: the sixteen signs of an edit script, in the order of their codes.
SCRIPT_SIGNS = "01234567ACGT-isN"


def pack4(script: Column) -> Column:
    """Two signs of an edit script a byte; an odd last half is F."""
    h = F.translate(script, SCRIPT_SIGNS, "0123456789ABCDEF")
    return F.unhex(F.when(F.length(h) % 2 == 1, F.concat(h, F.lit("F"))).otherwise(h))


def unpack4(data: Column, n: Column) -> Column:
    return F.when(n > 0, F.substring(F.translate(F.hex(data), "0123456789ABCDEF", SCRIPT_SIGNS), F.lit(1), n)).otherwise(F.lit(""))


def phred_gate(rows: DataFrame, rec: str, qual: str, width: int = 36, stride: int = 12, least: float = -1.0) -> DataFrame:
    """rec, pos, log_prob of the places at every ``stride``-th letter where the chance that all ``width`` letters are right exceeds 10**least."""
    p = F.transform(F.split(qual, ""), lambda q: F.when(F.ascii(q) <= 33, F.lit(-10.0)).otherwise(F.log10(1 - F.pow(F.lit(10.0), -(F.ascii(q) - 33) / 10.0))))
    rows = rows.where(F.length(qual) >= width).select(rec, p.alias("p"))
    each = rows.select(rec, "p", F.explode(F.sequence(F.lit(0), F.size("p") - width, F.lit(stride))).alias("pos"))
    total = F.aggregate(F.slice("p", F.col("pos") + 1, width), F.lit(0.0), lambda a, x: a + x)
    return each.select(rec, "pos", F.round(total, 6).alias("log_prob")).where(F.col("log_prob") > least)


def best_earlier_match(reads: DataFrame, rec: str, seq: str, k: int = 36, stride: int = 12, collisions: int = 10, places: DataFrame | None = None) -> DataFrame:
    """rec, pos, from_rec, from_pos, match_len: each read's longest repeat of an earlier read, of k letters at least.

    Earlier reads are indexed at every ``stride``-th place, at most the first ``collisions`` places of a k-mer (as the index is defined, so
    that common k-mers do not meet all reads). Of equals the earliest read and place. places: r, pos of the only places to index.
    """
    rows = reads.select(F.col(rec).alias("r"), F.col(seq).alias("s")).where(F.length("s") >= k)
    rank = F.row_number().over(W.partitionBy("kmer").orderBy("r", "pos"))
    every = kmers(rows, ["r"], "s", k, stride)
    index = (every if places is None else every.join(places, ["r", "pos"], "left_semi")).withColumn("n", rank).where(F.col("n") <= collisions).select("kmer", F.col("r").alias("from_rec"), F.col("pos").alias("from_pos"))
    hits = kmers(rows, ["r"], "s", k).join(index, "kmer").where("from_rec < r").select("r", "pos", "from_rec", "from_pos")
    j = hits.join(rows, "r").join(rows.select(F.col("r").alias("from_rec"), F.col("s").alias("t")), "from_rec")
    most = F.least(F.length("s") - F.col("pos"), F.length("t") - F.col("from_pos"))
    # the first place where both differ, behind the common k-mer
    tail = lambda c, p: F.substring(F.col(c), F.col(p) + 1, most)
    j = j.withColumns({"a": tail("s", "pos"), "b": tail("t", "from_pos"), "most": most})
    differ = F.array_min(F.filter(F.sequence(F.lit(k + 1), F.greatest("most", F.lit(k + 1))), lambda i: (i > F.col("most")) | (F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1)))))
    j = j.withColumn("match_len", F.coalesce(differ - 1, F.col("most")).cast("int"))
    best = F.min_by(F.struct("pos", "from_rec", "from_pos", "match_len"), F.struct(-F.col("match_len"), F.col("from_rec"), F.col("from_pos"), F.col("pos")))
    return j.groupBy("r").agg(best.alias("__b")).select(F.col("r").alias(rec), "__b.pos", "__b.from_rec", "__b.from_pos", "__b.match_len")


def matched(matches: DataFrame, reads: DataFrame, rec: str, seq: str) -> DataFrame:
    """match_id, letters: what each match (match_id, rec_no, rec_offset, match_len) stands for, cut from the read that it names; null where that is not there or too short."""
    rows = reads.select(F.col(rec).alias("rec_no"), F.col(seq).alias("s"))
    j = matches.select("match_id", "rec_no", "rec_offset", "match_len").distinct().join(rows, "rec_no", "left")
    fits = (F.col("rec_offset") >= 0) & (F.col("match_len") > 0) & (F.col("rec_offset") + F.col("match_len") <= F.length("s"))
    return j.select("match_id", F.when(fits, F.expr("substring(s, rec_offset + 1, match_len)")).alias("letters"))


def gated_matches(reads: DataFrame, rec: str, seq: str, qual: str, k: int = 36, stride: int = 12, collisions: int = 10, least: float = -1.0) -> DataFrame:
    """best_earlier_match with an index of those places only whose ``k`` letters are right with a chance above 10**least (phred_gate)."""
    gate = phred_gate(reads, rec, qual, k, stride, least).select(F.col(rec).alias("r"), "pos")
    return best_earlier_match(reads, rec, seq, k, stride, collisions, gate)


def longest_shared_prefix(reads: DataFrame, rec: str, seq: str, least: int = 20) -> DataFrame:
    """rec, prefix_len: the longest beginning of ``least`` letters or more that a read shares with another one.

    Of all texts in order the one before or behind has the longest common beginning. So texts with a common head are sorted, and each is
    held against its neighbours; equal texts are one row before they are sorted.
    """
    rows = reads.select(F.col(rec).alias("r"), F.col(seq).alias("s")).where(F.col(rec).isNotNull() & (F.length(seq) >= least))
    texts = rows.groupBy("s").agg(F.count_distinct("r").alias("n"))
    head = W.partitionBy(F.substring("s", 1, least)).orderBy("s")
    near = texts.select("s", "n", F.lag("s").over(head).alias("a"), F.lead("s").over(head).alias("b")).where("a is not null or b is not null or n > 1")

    def common(x: str, y: str | None) -> int:
        if y is None:
            return 0
        m = min(len(x), len(y))
        differ = np.frombuffer(x[:m].encode("utf-32-le"), np.uint32) != np.frombuffer(y[:m].encode("utf-32-le"), np.uint32)
        return int(differ.argmax()) if differ.any() else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            n = [len(x) if k > 1 else max(common(x, y), common(x, z)) for x, k, y, z in zip(*(p.column(c).to_pylist() for c in ("s", "n", "a", "b")))]
            yield pa.RecordBatch.from_arrays([p.column("s"), pa.array(n, pa.int32())], names=["s", "prefix_len"])

    found = near.mapInArrow(run, "s string, prefix_len int").where(F.col("prefix_len") >= least)
    return rows.join(found, "s").select(F.col("r").alias(rec), "prefix_len").distinct()


def align(ref: str, read: str) -> tuple[str, str]:
    """Both texts with gaps (-) so that they have equal length, by least edit distance (Needleman-Wunsch with unit costs)."""
    a, b = np.frombuffer(ref.encode(), np.uint8), np.frombuffer(read.encode(), np.uint8)
    cost = np.empty((len(a) + 1, len(b) + 1), np.int32)
    cost[0], cost[:, 0] = np.arange(len(b) + 1), np.arange(len(a) + 1)
    steps = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        row = np.r_[i, best] - steps
        cost[i] = np.minimum.accumulate(row) + steps
    i, j, x, y = len(a), len(b), [], []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            x.append(ref[i])
            y.append(read[j])
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            x.append(ref[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(read[j])
    return "".join(reversed(x)), "".join(reversed(y))


def script_of(x: str, y: str) -> str:
    """The edits that make y of x, both with gaps (-) where the other has a letter more; see edit_script."""
    out, kind, since = [], "", 0
    for r, c in zip(x, y):
        if r == c:
            kind, since = "", since + 1
            continue
        want = "i" if r == "-" else "s"
        if want != kind:
            out.append(f"{want}{since:o}")
            kind, since = want, 0
        out.append(c)
    return "".join(out)


def edit_script(ref: str, read: str) -> str:
    """``i`` or ``s``, the octal distance in the read from the last edit's end, and letters: inserted ones, or those that replace the reference's (- deletes one)."""
    return script_of(*align(ref, read))


def apply_script(ref: str, script: str) -> str:
    """The read that edit_script described."""
    out, at, k = [], 0, 0
    while k < len(script):
        kind, k, n = script[k], k + 1, 0
        while k < len(script) and script[k] in "01234567":
            n, k = n * 8 + int(script[k]), k + 1
        out.append(ref[at : at + n])
        at += n
        while k < len(script) and script[k] not in "is":
            if script[k] != "-":
                out.append(script[k])
            at += kind == "s"
            k += 1
    out.append(ref[at:])
    return "".join(out)


def edit_scripts(pairs: DataFrame, key: list[str], ref: str, read: str) -> DataFrame:
    """key, script, whole (the read, where its script would be longer than it by more than two): Arrow batches, a pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [edit_script(x, y) for x, y in zip(b.column(ref).to_pylist(), b.column(read).to_pylist())]
            long = [len(m) > len(y) + 2 for m, y in zip(made, b.column(read).to_pylist())]
            script = pa.array([None if o else m for m, o in zip(made, long)], pa.string())
            whole = pa.array([y if o else None for y, o in zip(b.column(read).to_pylist(), long)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), script, whole], names=[*key, "script", "whole"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key)
    return pairs.select(*key, ref, read).where(F.col(ref).isNotNull() & F.col(read).isNotNull()).mapInArrow(run, f"{kinds}, script string, whole string")


def applied(rows: DataFrame, key: list[str], ref: str) -> DataFrame:
    """key, read from ref and what edit_scripts made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [w if w is not None else apply_script(r, s) for r, s, w in zip(*(b.column(c).to_pylist() for c in (ref, "script", "whole")))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(out, pa.string())], names=[*key, "read"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.select(*key, ref, "script", "whole").mapInArrow(run, f"{kinds}, read string")
