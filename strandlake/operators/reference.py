"""Sequences written as edits of a reference: seeds, extension to both sides, links and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.sequence import apply_script

#: Letters by which an extension may shift against its seed, and other letters in a row of equal places up to which no alignment is tried.
BAND, FEW = 12, 2


#: Steps of an alignment: a letter of both, of the read alone, of the reference alone, none any more.
BOTH, READ, REF, DONE = 0, 1, 2, 3
#: Pairs aligned at a time, and the most bytes of their traces.
PAIRS, TRACE = 1024, 1 << 25


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, 0 behind the last, and where each begins."""
    flat = np.frombuffer(("".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    return flat.astype(np.uint8) if flat.max() < 256 else flat, np.cumsum([0, *map(len, texts)])[:-1]


def _columns(flat: np.ndarray, first: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """A column a text: the n letters from ``first`` on in steps of 1 or -1, then 0."""
    at = np.arange(n.max(initial=0))[:, None]
    return np.where(at < n, flat[np.where(at < n, first + step * at, len(flat) - 1)], 0).astype(flat.dtype)


def _steps(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """A column a pair: the steps from the end of read b back to its beginning (see extended), then DONE. la, lb: letters of each column."""
    t, at = np.arange(len(b))[:, None], min(len(a), len(b))
    other = np.count_nonzero((a[:at] != b[:at]) & (t[:at] < np.minimum(la, lb)), 0)
    plain = (la >= lb) & (other <= FEW)
    steps = np.where(t < lb, BOTH, DONE).astype(np.uint8)
    if plain.all():
        return steps
    hard = np.flatnonzero(~plain)
    hard = hard[np.argsort(lb[hard], kind="stable")]
    made = _banded(a[:, hard], la[hard], b[:, hard], lb[hard], band)
    out = np.full((max(len(made), len(steps)), len(lb)), DONE, np.uint8)
    out[: len(steps)] = steps
    out[:, hard] = DONE
    out[: len(made), hard] = made
    return out


def _banded(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: int) -> np.ndarray:
    """_steps of pairs in order of lb by least edit distance; costs are held for all pairs at once, a row for each shift against the diagonal."""
    longest, n, width = int(lb[-1]), len(lb), 2 * band + 1
    kind, far = (np.int16, 1 << 13) if longest + width < 1 << 12 else (np.int32, 1 << 29)
    whole, la = la, np.minimum(la, longest + band + 1)
    ref = np.zeros((longest + width, n), a.dtype)
    ref[band : band + min(len(a), longest + band)] = a[: longest + band]
    k = np.arange(width, dtype=kind)[:, None]
    cost = np.where((k >= band) & (k - band <= la), k - band, far).astype(kind)
    last, trace = np.empty((width, n), kind), np.full((longest + 1, width, n), REF, np.uint8)
    lo, hi = 0, int(np.searchsorted(lb, 0, "right"))
    last[:, :hi] = cost[:, :hi]
    for i in range(1, longest + 1):
        cost, lo = cost[:, hi - lo :], hi
        same = cost + (ref[i - 1 : i - 1 + width, lo:] != b[i - 1, lo:])
        same[: max(0, band + 1 - i)] = far
        one = cost[1:] + kind(1)
        best = same.copy()
        np.minimum(best[:-1], one, out=best[:-1])
        over = k > la[lo:] - i + band if i + band > la[lo:].min() else None
        best[: max(0, band - i)] = far
        if over is not None:
            best[over] = far
        best -= k
        for s in (1 << x for x in range(width.bit_length())):
            best[s:] = np.minimum(best[s:], best[:-s])
        best += k
        best[: max(0, band - i)] = far
        if over is not None:
            best[over] = far
        now = trace[i, :, lo:]
        now[:-1][best[:-1] == one] = READ
        now[best == same] = BOTH
        cost, hi = best, int(np.searchsorted(lb, i, "right"))
        last[:, lo:hi] = cost[:, : hi - lo]
    short = last.min(0) >= far  # ref is too short to be within the band: the rest of the read is inserted
    i, d, every = np.where(short, 0, lb), np.where(short, band, last.argmin(0)), np.arange(n)
    out = []
    while (live := (i > 0) | (d != band)).any():
        step = np.where(live, trace[i, d, every], DONE).astype(np.uint8)
        out.append(step)
        i = i - (step < REF)
        d = d + (step == READ) - (step == REF)
    steps = np.full((max(len(out), longest), n), DONE, np.uint8)
    steps[: len(out)] = np.array(out, np.uint8).reshape(len(out), n)
    t, rest = np.arange(len(steps))[:, None], np.maximum(lb - whole, 0)
    return np.where(short & (t < lb), np.where(t < rest, READ, BOTH), steps).astype(np.uint8)


def extended(ref: str, read: str, band: int = BAND) -> tuple[str, str]:
    """The read and as much of the beginning of ref as suits it, with gaps (-), by least edit distance within ``band`` of the diagonal; what is left of ref costs nothing."""
    (a, i), (b, j) = _letters([ref]), _letters([read])
    la, lb = np.array([len(ref)]), np.array([len(read)])
    x, y, i, j = [], [], 0, 0
    for step in _steps(_columns(a, i, la, 1), la, _columns(b, j, lb, 1), lb, band)[::-1, 0].tolist():
        if step != DONE:
            x.append("-" if step == READ else ref[i])
            y.append("-" if step == REF else read[j])
            i, j = i + (step != READ), j + (step != REF)
    return "".join(x), "".join(y)


def _linked(seqs: list[str], pos: np.ndarray, around: list[str], k: np.ndarray, seed: int, band: int) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Scripts of reads whose seeds are at pos and at k of what is around in the reference, None for those longer than the read by more than two; letters of the reference before the seed and in all."""
    (s, s0), (a, a0) = _letters(seqs), _letters(around)
    ls, la = np.array([len(x) for x in seqs]), np.array([len(x) for x in around])
    left = _steps(_columns(a, a0 + k - 1, k, -1), k, _columns(s, s0 + pos - 1, pos, -1), pos, band)
    ra, rs = np.maximum(la - k - seed, 0), ls - pos - seed
    right = _steps(_columns(a, a0 + k + seed, ra, 1), ra, _columns(s, s0 + pos + seed, rs, 1), rs, band)
    used = np.count_nonzero((left == BOTH) | (left == REF), 0)
    steps = np.concatenate([left, np.full((seed, len(seqs)), BOTH, np.uint8), right[::-1]]).T
    of_read, of_ref = steps < REF, (steps == BOTH) | (steps == REF)
    there = steps != DONE
    row = np.nonzero(there)[0]
    step = steps[there]
    mine = s[np.minimum(s0[:, None] + np.maximum(np.cumsum(of_read, 1) - 1, 0), len(s) - 1)[there]]
    its = a[np.minimum((a0 + k - used)[:, None] + np.maximum(np.cumsum(of_ref, 1) - 1, 0), len(a) - 1)[there]]
    kind = np.where(step == READ, 2, (step == REF) | (mine != its)).astype(np.uint8)
    # runs of edits of one kind, and the equal letters before each
    edit = np.flatnonzero(kind)
    first = np.searchsorted(row, np.arange(len(seqs)))
    before = np.maximum(np.r_[-1, edit[:-1]], first[row[edit]] - 1) if len(edit) else edit
    since = edit - before - 1
    begins = np.flatnonzero((since > 0) | (edit == first[row[edit]]) | (kind[edit] != kind[before]))
    digits = np.ones(len(begins), np.int64)
    far = since[begins]
    while (far := far >> 3).any():
        digits += far > 0
    size = np.bincount(row[edit], minlength=len(seqs)) + np.bincount(row[edit[begins]], 1 + digits, len(seqs)).astype(np.int64)
    fits = size <= ls + 2
    letters = np.where(step[edit] == REF, ord("-"), mine[edit])
    text = letters.astype(np.uint32).tobytes().decode("utf-32-le")
    scripts: list[str | None] = ["" if x else None for x in fits]
    parts: dict[int, list[str]] = {}
    ends = np.r_[begins[1:], len(edit)] if len(begins) else begins
    some = fits[row[edit[begins]]]
    for r, w, n, x, y in zip(*(v[some].tolist() for v in (row[edit[begins]], kind[edit[begins]], since[begins], begins, ends))):
        parts.setdefault(r, []).append(f"{'.si'[w]}{n:o}{text[x:y]}")
    for r, made in parts.items():
        scripts[r] = "".join(made)
    return scripts, used, np.count_nonzero(of_ref, 1)


_LINKS = "ref_seq_no int, ref_pos int, ref_len int, script string"


def encode(reads: DataFrame, rec: str, seq: str, hits: DataFrame, fragments: DataFrame, seed: int = 10, band: int = BAND) -> DataFrame:
    """rec, ref_seq_no, ref_pos, ref_len, script: each sequence as a link into the reference and the edits that make it of what is there.

    hits: rec, pos, ref_seq_no, ref_pos (sequence.first_seed_hits, first_hits). From the seed the sequence is extended to both sides (extended). Where it has
    no hit, or the script would be longer than it by more than two, the link is -1, -1, -1 and the script ``s0`` and the sequence. Only the part
    of a fragment that the band can reach is carried along; it is cut by bytes, as fragments are A, C, G and T. Null sequences have null scripts.
    """
    first = F.greatest(F.col("ref_pos") - F.col("pos") - band, F.lit(0))
    last = F.col("ref_pos") + F.col("letters") - F.col("pos") + band
    cut = hits.join(reads.select(rec, F.length(seq).alias("letters")), rec).join(fragments.select("ref_seq_no", "bases"), "ref_seq_no")
    near = cut.select(rec, "pos", "ref_seq_no", "ref_pos", first.alias("first"), F.substring(F.col("bases").cast("binary"), first + 1, last - first).cast("string").alias("around"))
    rows = reads.select(rec, seq).join(near, rec, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, p, no, at, begin, around = (b.column(c).to_pylist() for c in (seq, "pos", "ref_seq_no", "ref_pos", "first", "around"))
            out = [(-1, -1, -1, None if x is None else "s0" + x) for x in s]
            todo = sorted((i for i, x in enumerate(s) if x is not None and no[i] is not None), key=lambda i: len(s[i]))
            while todo:
                # the longest read of those taken gives the width of all
                most = max(1, min(PAIRS, TRACE // ((2 * band + 1) * (len(s[todo[-1]]) + 1))))
                some = todo[-most:]
                del todo[-most:]
                take = lambda v: [v[i] for i in some]  # noqa: E731, B023
                scripts, used, letters = _linked(take(s), np.array(take(p)), take(around), np.array(take(at)) - np.array(take(begin)), seed, band)
                for i, script, u, n in zip(some, scripts, used.tolist(), letters.tolist()):
                    if script is not None:
                        out[i] = (no[i], at[i] - u, n, script)
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(rec), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string())))], names=[rec, "ref_seq_no", "ref_pos", "ref_len", "script"])

    return rows.mapInArrow(run, f"`{rec}` {reads.schema[rec].dataType.simpleString()}, {_LINKS}")


def decode(coded: DataFrame, rec: str, fragments: DataFrame) -> DataFrame:
    """rec, seq from what encode made."""
    linked = coded.where("ref_seq_no >= 0").join(fragments.select("ref_seq_no", "bases"), "ref_seq_no")
    linked = linked.select(rec, "script", F.expr("cast(substring(cast(bases as binary), ref_pos + 1, ref_len) as string)").alias("ref"))
    rows = linked.unionByName(coded.where("ref_seq_no < 0").select(rec, "script", F.lit(None).cast("string").alias("ref")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if s is None else s[2:] if r is None else apply_script(r, s) for s, r in zip(b.column("script").to_pylist(), b.column("ref").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(rec), pa.array(made, pa.string())], names=[rec, "seq"])

    return rows.mapInArrow(run, f"`{rec}` {coded.schema[rec].dataType.simpleString()}, seq string")
