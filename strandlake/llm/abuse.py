"""Abusive, hateful or sexual content: non-negative positive-unlabelled learning over parts of sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.letters import distinct
from strandlake.llm.mail import text_parts
from strandlake.llm.words import TOP, mix, powers
from strandlake.runtime import written

#: Bounds of what is fitted on: labelled positive documents and their words, and units drawn from all documents for the gradient of the negative risk.
MAX_POSITIVE, MAX_WORDS, MAX_UNITS = 3_000, 3_000_000, 80_000
#: Scores of drawn units that are tried as thresholds besides those of left-out positive documents.
LEVELS = 2_000
#: Hashed features, and words in a unit.
SPACE, WIDTH = 1 << 22, 16
#: Features added to a unit's number of them for scaling, so that a word or two weigh little.
SHORT = 12
PIECE = 1_000_000
#: Places of sparse rows that are summed at a time, so that they stay in a processor's cache.
BLOCK = 1 << 16

#: Digits and signs written for letters.
LOOKS_LIKE = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "7": "t", "$": "t"}
#: Cyrillic and Greek letters written for Latin ones.
LOOKALIKES = dict(zip("авеікмнорстухѕјһԁαειοκνρτυ", "abeikmhopctyxsjhdaeioknptu"))


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 for no letter, 1 for a letter or digit, 2 for what is passed over; and its plain lower-case form."""
    import unicodedata

    kind, plain = np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.uint32)
    for i in range(TOP):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalnum():
            kind[i] = 1
            low = unicodedata.normalize("NFKD", c)[0].lower() if i < 0x2000 else c.lower()
            plain[i] = ord(LOOKALIKES.get(low[0], low[0]))
        elif unicodedata.category(c) in ("Cf", "Mn"):
            kind[i] = 2
    return kind, plain


@cache
def letter_values() -> np.ndarray:
    """A hash of each plain letter."""
    return mix(np.arange(TOP, dtype=np.uint64) + np.uint64(1))


class Units:
    """Words of texts with obfuscation undone, cut into units: sentences, and in longer ones overlapping windows of WIDTH words.

    Invisible characters and accents are dropped, single letters joined by signs are put together, signs and digits inside words are read
    as the letters they look like, and repeated letters count once.
    """

    def __init__(self, owner: list[int], texts: list[str], kind: np.ndarray, plain: np.ndarray):
        code = np.frombuffer("\n\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, TOP - 1)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        start = np.r_[0, np.cumsum(size)[:-1]]
        k = kind[code]
        at = np.flatnonzero(k != 2)
        code, k = code[at], k[at] == 1
        pad = lambda x, n: np.r_[np.zeros(n, x.dtype), x, np.zeros(n, x.dtype)]
        # signs written for letters, inside words only
        p = pad(k, 1)
        any_of = lambda chars: np.logical_or.reduce([code == np.uint32(ord(c)) for c in chars])
        sign = any_of("$@") & (p[:-2] | p[2:])
        k = k | sign
        # s.p.e.l.l.e.d words: a sign between two single letters goes
        p = pad(k, 2)
        joint = any_of("-.*_") & p[1:-3] & p[3:-1] & ~p[:-4] & ~p[4:]
        keep = ~joint
        code, k, at = code[keep], k[keep], at[keep]
        low = plain[code]
        numeric = (low >= 48) & (low <= 57)
        swap = np.arange(128, dtype=np.uint32)
        for a, b in LOOKS_LIKE.items():
            swap[ord(a)] = ord(b)
        p = pad(k, 1)
        edge = np.flatnonzero(p[1:] != p[:-1])
        begin, end = edge[::2], edge[1::2]
        # of words from begin to begin, as no letter and no figure is between them
        some = lambda x: np.logical_or.reduceat(x, begin) if len(begin) else np.zeros(0, bool)
        figure = ~some(k & ~numeric)  # only digits: any number
        small = low < 128
        low = np.where(small, swap[np.minimum(low, 127)], low)
        use = k.copy()
        use[1:] &= ~((low[1:] == low[:-1]) & k[:-1])  # not again
        inner = np.flatnonzero(use)
        head = np.zeros(len(code), bool)
        head[begin] = True
        first = np.flatnonzero(head[inner])  # a word's first letter is always used
        last = np.r_[first[1:], len(inner)][: len(first)]
        place = np.arange(len(inner), dtype=np.int32) - np.repeat(first.astype(np.int32), last - first)
        n = int((last - first).max()) if len(first) else 0
        total = np.zeros(len(inner) + 1, np.uint64)
        np.cumsum(letter_values()[low[inner]] * powers(n, 0x100000001B3)[place], out=total[1:])
        # 32 bits a word, as they are stored
        word = mix(total[last] - total[first]) >> np.uint64(32)
        stem = mix(total[np.minimum(first + 5, last)] - total[first] + np.uint64(5)) >> np.uint64(32)
        word[figure] = stem[figure] = np.uint64(1)
        # sentences end at . ! ? before white space, and at blank lines
        white = (code == 32) | (code == 10)
        nxt = np.r_[code[1:], np.uint32(10)]
        stop = (any_of(".!?") & np.r_[white[1:], True]) | ((code == 10) & (nxt == 10)) | ((code == 58) & (nxt == 10))
        text = np.searchsorted(start, at[begin], "right") - 1 if len(begin) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.r_[True, some(stop)[:-1] | (text[1:] != text[:-1])]) if len(begin) else np.zeros(0, np.int64)
        self._window(np.array(owner, np.int64)[text[cut]] if len(cut) else np.zeros(0, np.int64), np.diff(np.r_[cut, len(begin)]), word, stem)

    @classmethod
    def stored(cls, owner: np.ndarray, size: np.ndarray, word: np.ndarray, stem: np.ndarray) -> Units:
        """Units of sentences given by their owners and sizes and the hashes of their words."""
        out = cls.__new__(cls)
        out._window(owner, size.astype(np.int64), *(x.view(np.uint32).astype(np.uint64) for x in (word, stem)))
        return out

    def _window(self, owner: np.ndarray, size: np.ndarray, word: np.ndarray, stem: np.ndarray) -> None:
        self.sentences, self.word, self.stem = (owner, size), word, stem
        cut = np.cumsum(size) - size
        # windows of a sentence: every WIDTH / 2 words, the last one at its end
        times = np.maximum(1, -(-(size - WIDTH // 2) // (WIDTH // 2)))
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        base, whole = np.repeat(cut, times), np.repeat(size, times)
        self.start = base + np.minimum(turn * (WIDTH // 2), np.maximum(0, whole - WIDTH))
        self.end = np.minimum(self.start + WIDTH, base + whole)
        self.owner = np.repeat(owner, times)

    def features(self) -> list[tuple[np.ndarray, int]]:
        """Feature number of each word, its beginning, each pair of words, pair with a gap, and triple; and how many words further it reaches."""
        w, far = self.word, lambda n: np.r_[self.word[n:], np.zeros(min(n, len(self.word)), np.uint64)]
        c = np.uint64(0x9E3779B97F4A7C55)
        pair = mix(w * c + far(1))
        found = [(mix(w), 0), (mix(self.stem + np.uint64(1 << 33)), 0), (pair, 1), (mix(w * c + far(2) + np.uint64(2)), 2), (mix(pair * c + far(2)), 2)]
        return [((x >> np.uint64(40) & np.uint64(SPACE - 1)).view(np.int64), reach) for x, reach in found]

    def scores(self, weight: np.ndarray, bias: float) -> np.ndarray:
        total, n = np.zeros(len(self.start)), np.zeros(len(self.start))
        for number, reach in self.features():
            c = np.r_[0.0, np.cumsum(weight[number])]
            end = np.maximum(self.end - reach, self.start)
            total += c[end] - c[self.start]
            n += end - self.start
        return bias + total / np.sqrt(n + SHORT)

    def lists(self, some: np.ndarray | slice = slice(None)) -> pa.ListArray:
        """The feature numbers of each unit, or of some: kind after kind, in the order of its words."""
        start, end = self.start[some], self.end[some]
        both = self.features()
        sizes = [np.maximum(0, end - start - reach) for _, reach in both]
        ends = np.r_[0, np.cumsum(sum(sizes))]
        out, at = np.empty(ends[-1], np.int32), ends[:-1]
        for (x, _), n in zip(both, sizes):
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at, n) + within] = x[np.repeat(start, n) + within]
            at = at + n
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature, its numbers at all places that lie in a unit, and the owners of these places."""
        owner, size = self.sentences
        # the windows of a sentence overlap by more words than any feature reaches, so only its end is short of them
        left, owner = np.repeat(np.cumsum(size), size) - np.arange(size.sum()), np.repeat(owner, size)
        for x, reach in self.features():
            at = np.flatnonzero(left > reach)
            yield x[at], owner[at]


_WORDS_DDL = "doc_id bigint, units int, word array<int>, stem array<int>, size array<int>"
_WORDS = pa.schema([("doc_id", pa.int64()), ("units", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("word", "stem", "size"))])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, plain = letter_tables()

    def some(ids: list[int], owner: list[int], texts: list[str]) -> pa.RecordBatch:
        u = Units(owner, texts, kind, plain)
        whose, size = u.sentences
        n = len(ids)
        sentences, words = np.bincount(whose, minlength=n), np.bincount(whose, size, n).astype(np.int64)
        some = np.flatnonzero(sentences)
        cut = lambda x: pa.array(np.r_[0, np.cumsum(x[some])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut(k), pa.array(v)) for k, v in ((words, u.word.astype(np.uint32).view(np.int32)), (words, u.stem.astype(np.uint32).view(np.int32)), (sentences, size.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[some]), pa.array(np.bincount(u.owner, minlength=n)[some].astype(np.int32)), *lists], schema=_WORDS)

    for b in batches:
        ids, owner, texts, letters = [], [], [], 0
        for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            for t in text_parts(raw):
                owner.append(len(ids))
                texts.append(t)
                letters += len(t)
            ids.append(i)
            if letters > PIECE:
                yield some(ids, owner, texts)
                ids, owner, texts, letters = [], [], [], 0
        if texts:
            yield some(ids, owner, texts)


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, units, word, stem, size: documents (doc_id, text) as hashes of the words and word beginnings of their subjects and text parts, with the
    number of words of each sentence. Documents without words have no row. Messages are decoded here and nowhere else."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(_worded, _WORDS_DDL)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Units, np.ndarray, np.ndarray]]:
    """Units owned by rows (numbered in each piece), the rows' ids, and their weights: 1 by the number of rows with the id."""
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        copies = b.column("copies").fill_null(1).to_numpy() if "copies" in b.schema.names else np.ones(len(b))
        words = b.column("word").value_lengths().to_numpy()
        at, total = 0, np.cumsum(words)
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE // 4, "right")))
            piece = b.slice(at, end - at)
            word, stem, size = (piece.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("word", "stem", "size"))
            owner = np.repeat(np.arange(end - at), piece.column("size").value_lengths().to_numpy())
            yield Units.stored(owner, size, word, stem), ids[at:end], 1 / copies[at:end]
            at = end


_LISTED_DDL = "doc_id bigint, features array<int>"
_LISTED = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32()))])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, ids, _weight in _units(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids[u.owner]), u.lists()], schema=_LISTED)


_COUNTED_DDL = "kind int, key bigint, n double, features array<int>"
_COUNTED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.float64()), ("features", pa.list_(pa.int32()))])


def _counted(known: np.ndarray, rate: float):
    """One pass over documents. Kind 0: a known feature's number and in how many documents it stands; 1: a unit drawn at ``rate``, by a
    digest; 2: documents with words (key 0) and their units (key 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(SPACE, -1, np.int32)
        column[known] = np.arange(len(known))
        count, docs, units = np.zeros(len(known)), 0.0, 0.0
        for u, ids, weight in _units(batches):
            found = []
            for number, row in u.places():
                c = column[number]
                ok = np.flatnonzero(c >= 0)
                found.append(row[ok] * len(known) + c[ok])
            both = distinct(np.concatenate(found))
            if len(known):
                count += np.bincount(both % len(known), weight[both // len(known)], len(known))
            first = np.flatnonzero(np.r_[True, u.owner[1:] != u.owner[:-1]])
            docs += weight[u.owner[first]].sum()
            units += weight[u.owner].sum()
            turn = np.arange(len(u.owner)) - np.repeat(first, np.diff(np.r_[first, len(u.owner)]))
            key = mix(mix(ids[u.owner].astype(np.uint64) + np.uint64(5)) + turn.astype(np.uint64)) >> np.uint64(1)
            drawn = np.flatnonzero(key < rate * 2.0**63)
            if len(drawn):
                n = len(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 1, np.int32)), pa.array(key[drawn].astype(np.int64)), pa.nulls(n, pa.float64()), u.lists(drawn)], schema=_COUNTED)
        some = np.flatnonzero(count)
        kind = np.r_[np.zeros(len(some), np.int32), np.full(2, 2, np.int32)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[known[some], 0, 1].astype(np.int64)), pa.array(np.r_[count[some], docs, units]), pa.nulls(len(kind), pa.list_(pa.int32()))], schema=_COUNTED)

    return run


_BINNED_DDL = "bin int, n double, most double"


def _dense(known: np.ndarray, w: np.ndarray) -> np.ndarray:
    weight = np.zeros(SPACE, np.float32)
    weight[known] = w
    return weight


def _binned(models: list[tuple[np.ndarray, np.ndarray, float]], levels: np.ndarray):
    """The histogram of documents' scores by all models between ``levels`` (bin: levels that a score reaches), with each bin's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [(_dense(known, w), bias) for known, w, bias in models]
        n, most = np.zeros(len(levels) + 1), np.full(len(levels) + 1, -np.inf)
        for u, _ids, weight in _units(batches):
            at = np.flatnonzero(np.r_[True, u.owner[1:] != u.owner[:-1]])
            for w, bias in dense:
                z = np.maximum.reduceat(u.scores(w, bias), at)
                b = np.searchsorted(levels, z, "right")
                n += np.bincount(b, weight[u.owner[at]], len(n))
                np.maximum.at(most, b, z)
        some = np.flatnonzero(n).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(most[some])], names=["bin", "n", "most"])

    return run


class _Rows:
    """Sparse rows of counted features, scaled by the root of their length, with columns numbered by ``known``."""

    def __init__(self, lists: list[np.ndarray], known: np.ndarray):
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        number = np.full(SPACE, -1, np.int32)
        number[known] = np.arange(len(known))
        found = number[flat]
        ok = found >= 0
        self.row, self.column = np.repeat(np.arange(len(lists), dtype=np.int32), size)[ok], found[ok]
        self.n, self.width = len(lists), len(known)
        self.scale = 1 / np.sqrt(size + SHORT)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) * self.scale

    @cached_property
    def packed(self) -> _Packed:
        return _Packed(self)


def _alike(owner: np.ndarray, member: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n owners in order with their members: one of each group that has the same members as often and in the same order, and each owner's group."""
    digest = np.random.default_rng(0).integers(0, 1 << 64, int(member.max(initial=0)) + 1, np.uint64)
    total = np.r_[np.uint64(0), digest[member].cumsum(dtype=np.uint64)]
    count = np.bincount(owner, minlength=n)
    end = np.cumsum(count)
    _, first, group = np.unique(total[end] - total[end - count], return_index=True, return_inverse=True)
    # the digest only proposes: who differs from the first of the group stays alone
    like = first[group]
    at = np.arange(len(member)) + np.repeat((end - count)[like] - (end - count), count)
    other = np.bincount(owner, member[np.minimum(at, len(member) - 1)] != member, n) > 0
    alone = np.flatnonzero(other | (count != count[like]))
    group[alone] = len(first) + np.arange(len(alone))
    return np.r_[first, alone], group


class _Packed:
    """The two products of rows that a fit takes some sixty times, which is most of its time.

    Rows with the same features are one row here, and features that stand in the same rows one column (a short word and its beginning, the pairs
    and triples of a phrase): a product is the same for all of them. The places are kept in two orders: by their turn in the row, in which a
    product is a few dozen sums of vectors over rows, longest first; and by column.
    """

    def __init__(self, rows: _Rows):
        self.scale, low = rows.scale, np.int64(0xFFFFFFFF)
        pick = lambda first, n: np.bincount(first, minlength=n).astype(bool)
        first, self.row = _alike(rows.row, rows.column, rows.n)
        keep, self.n = pick(first, rows.n)[rows.row], len(first)
        place = np.sort(rows.column[keep].astype(np.int64) << 32 | self.row[rows.row[keep]])
        column, row = place >> 32, place & low
        first, self.column = _alike(column, row, rows.width)
        keep, self.width = pick(first, rows.width)[column], len(first)
        column, row = self.column[column[keep]], row[keep]
        place = np.sort(column << 32 | row)
        column, row = place >> 32, place & low
        begin = np.flatnonzero(np.r_[True, column[1:] != column[:-1]][: len(column)])
        part = np.split(begin, np.flatnonzero(np.diff(begin // BLOCK)) + 1) if len(begin) else []
        ends = [*(x[0] for x in part[1:]), len(row)]
        self.blocks = [(column[x], x - x[0], row[x[0] : end]) for x, end in zip(part, ends)]
        column = np.sort(row << 32 | column) & low
        size = np.bincount(row, minlength=self.n)
        self.order = np.argsort(-size, kind="stable")
        at, size = (np.cumsum(size) - size)[self.order], size[self.order]
        self.turns = [column[at[: np.searchsorted(-size, -turn)] + turn] for turn in range(size[0] if self.n else 0)]

    def times(self, w: np.ndarray) -> np.ndarray:
        w = np.bincount(self.column, w, self.width)
        total, out, room = np.zeros(self.n), np.empty(self.n), np.empty(self.n)
        for c in self.turns:
            total[: len(c)] += np.take(w, c, out=room[: len(c)], mode="clip")
        out[self.order] = total
        return out[self.row] * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        g, out = np.bincount(self.row, g * self.scale, self.n), np.zeros(self.width)
        for column, begin, row in self.blocks:
            out[column] = np.add.reduceat(np.take(g, row, mode="clip"), begin)
        return out[self.column]


def nnpu(p: _Rows, u: _Rows, prior: float, share: float = 0.5, rounds: int = 60, rate: float = 0.15, pull: float = 0.12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimise share * R+(p) + (1 - share) / (1 - prior) * max(0, R-(u) - prior * R-(p)).

    The risks are means of the logistic loss; R-(u) - prior * R-(p) estimates the risk of the negatives from unlabelled rows of which the
    share ``prior`` is positive, and ``share`` weighs the two classes, as
    positive rows are rare. Weights are drawn to 0 by ``pull`` divided by the number of positive rows. Where the estimated risk of the negatives falls below 0, its own gradient is climbed instead, as it can only do so by overfitting.
    """
    w, bias = np.zeros(p.width), 0.0
    m, v, mb, vb = np.zeros(p.width), np.zeros(p.width), 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    heavy, light, decay = share, (1 - share) / (1 - prior), pull / max(1, p.n)
    for t in range(1, rounds + 1):
        zp, zu = p.packed.times(w) + bias, u.packed.times(w) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu = -heavy * sig(-zp) / p.n, -light * prior * sig(zp) / p.n, light * sig(zu) / u.n
        a, b = (gp_plus + gp_minus, gu) if negative >= 0 else (-gp_minus, -gu)
        g, gb = p.packed.back(a) + u.packed.back(b) + decay * w, a.sum() + b.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    return w, bias


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    threshold: float


def _best(units: dict[int, list[np.ndarray]], known: np.ndarray, w: np.ndarray, bias: float) -> dict[int, np.ndarray]:
    ids = [i for i, x in units.items() for _ in x]
    z = _Rows([f for x in units.values() for f in x], known).times(w) + bias
    out, at = {}, 0
    for i, x in units.items():
        out[i] = z[at : at + len(x)]
        at += len(x)
    assert at == len(ids)
    return out


def _learn(positive: dict[int, list[np.ndarray]], outside: np.ndarray, docs_outside: float, units: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Known features, weights, bias, from the units of positive documents, the number of all documents with each feature, and units drawn from those.

    Which units make a positive document positive is not known, and some documents are labelled wrongly. First, units count whose features
    stand in more positive documents than chance explains; then, in two halves, those that the other half's classifier places among
    the highest unlabelled ones.
    """
    docs = [distinct(np.concatenate(x)) for x in positive.values()]
    inside = np.bincount(np.concatenate(docs), minlength=SPACE)
    known = np.flatnonzero(inside >= min(2, len(docs))).astype(np.int32)
    expected = len(docs) * outside[known] / docs_outside
    # positive passages are rare among the unlabelled: their features are several times as frequent in positive documents
    first = np.maximum(np.log((inside[known] + 0.5) / (expected + 0.5)) - 1 / np.sqrt(inside[known]) - 1, 0)
    keep = (first > 0) | (outside[known] >= 0.01 * docs_outside)
    known, first = known[keep], first[keep]
    u = _Rows(units, known)
    score = _best(positive, known, first, 0.0)
    usual = np.median([z.max() for z in score.values()])
    chosen = {i: [positive[i][k] for k in np.flatnonzero(z >= max(0.4 * usual, 0.7 * z.max()))] for i, z in score.items()}
    ids = list(positive)
    again = {i: [] for i in ids}
    for half in (0, 1):
        train = [f for i in ids[half::2] for f in chosen[i]]
        test = {i: positive[i] for i in ids[1 - half :: 2]}
        if train and test:
            w, bias = nnpu(_Rows(train, known), u, prior)
            high = max(0.0, float(np.quantile(u.times(w) + bias, 1 - prior)))
            for i, z in _best(test, known, w, bias).items():
                again[i] = [positive[i][k] for k in np.flatnonzero(z >= max(high, 0.5 * z.max()))]
    # where no unit is confirmed by the other half, the first choice stands
    train = [f for i in ids for f in again[i]] or [f for i in ids for f in chosen[i]] or [positive[i][int(np.argmax(score[i]))] for i in ids]
    w, bias = nnpu(_Rows(train, known), u, prior)
    return known, w, bias


def _cut(positive: np.ndarray, levels: np.ndarray, n: np.ndarray, most: np.ndarray, limit: float = 1.0) -> tuple[float, float, float]:
    """The threshold with the best F1 in the whole collection, of those that flag no more than can be positive; the share of positive documents; and how high it can be.

    positive: scores of positive documents that were left out of the fit; levels: thresholds to try, increasing; n, most: of the scores of
    all documents, the number and the highest that reach exactly so many levels; limit: a bound of the share from elsewhere. With recall R
    and flagged share F at a threshold, no more than F / R can be positive; the least such bound is the share, and share * R / F the
    precision. With R lower by two standard errors the least bound is how high the share can be. So the labels may be drawn with another share of positives than the collection has.
    """
    recall = 1 - np.searchsorted(np.sort(positive), levels, "left") / len(positive)
    flagged = np.cumsum(n[::-1])[::-1][1:] / n.sum()
    least = lambda r: min(limit, float(((flagged + 1 / n.sum()) / r)[ok].min())) if (ok := (recall >= 0.3) & (r > 0)).any() else limit
    with np.errstate(divide="ignore", invalid="ignore"):
        share, high = least(recall), least(recall - 2 * np.sqrt(recall * (1 - recall) / len(positive)))
    precision = np.minimum(1, share * recall / np.maximum(flagged, 1e-12))
    f1 = np.where(flagged <= high, 2 * precision * recall / np.maximum(precision + recall, 1e-12), -1)
    if not len(f1) or f1.max() <= 0:
        return float(np.inf), share, high
    return _between(int(np.argmax(f1)), levels, most), share, high


def _between(k: int, levels: np.ndarray, most: np.ndarray) -> float:
    """A level, lowered to midway to the highest score below it."""
    below = float(most[: k + 1].max())
    return float((levels[k] + max(below, levels[k] - 0.5)) / 2) if below > -np.inf else float(levels[k])


def _level(wanted: float, levels: np.ndarray, n: np.ndarray, most: np.ndarray) -> float:
    """The lowest of ``levels`` that at most the share ``wanted`` of all documents reach; see _between."""
    ok = np.flatnonzero(np.cumsum(n[::-1])[::-1][1:] <= wanted * n.sum() + 1e-9)
    if wanted <= 0 or not len(ok):
        return float(np.inf)
    return _between(int(ok[0]), levels, most)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 2, max_positive: int | None = None, max_words: int | None = None, max_units: int | None = None, words: DataFrame | None = None) -> Model | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic: 1 for positive, 0 for clean); None with fewer than two positive documents, or no others.

    The same steps at every size. At most ``max_positive`` (MAX_POSITIVE) positive documents with ``max_words`` (MAX_WORDS) words in all, taken by
    a digest of their ids, are fitted on; their features (no texts) come to the driver. The documents in which each of these features
    stands are counted over all documents. The gradient of the negative risk is taken on at most ``max_units`` (MAX_UNITS) units, drawn by
    a digest from all documents. The class prior is estimated with a first fit, from the scores of all documents and of positive ones that
    it did not see, and is taken to be no higher than among the labels (labels are given to suspicious documents rather than to others), with
    two standard errors more;
    the threshold likewise, with each positive document left out in turn, and no lower than where the last fit flags more documents than can be
    positive. Clean labels serve for that bound only.
    words: what ``worded`` makes of docs, where that is stored already.
    """
    max_positive, max_words, max_units = max_positive or MAX_POSITIVE, max_words or MAX_WORDS, max_units or MAX_UNITS
    digest = F.xxhash64(F.lit(11), "doc_id")
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rate, given = told.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    if not rate:
        return None
    limit = min(1.0, rate + 2 * np.sqrt(rate * (1 - rate) / given))
    words = written(worded(docs), "words") if words is None else words
    chosen = told.where("toxic = 1").orderBy(digest, "doc_id").limit(max_positive).select("doc_id")
    ids = words.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen.collect()], "doc_id bigint")
    mine = words.join(F.broadcast(ids), "doc_id", "left_semi")
    size = mine.groupBy("doc_id").agg(F.max(F.size("word")).alias("n")).orderBy(digest, "doc_id").collect()
    kept = [r["doc_id"] for r, total in zip(size, np.cumsum([r["n"] for r in size])) if total <= max_words]
    if len(kept) < 2:
        return None
    if len(kept) < len(size):
        mine = words.join(F.broadcast(words.sparkSession.createDataFrame([(i,) for i in kept], "doc_id bigint")), "doc_id", "left_semi")
    listed = mine.distinct().mapInArrow(_listed, _LISTED_DDL).toArrow()  # rows sent twice count once, what a document says twice does not
    units: dict[int, list[np.ndarray]] = {}
    values, owner = listed.column("features").combine_chunks(), listed.column("doc_id").to_pylist()
    flat, ends = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
    for i, _, a, b in sorted((i, flat[a : a + 8].tolist(), a, b) for i, a, b in zip(owner, ends[:-1].tolist(), ends[1:].tolist())):
        units.setdefault(i, []).append(flat[a:b])
    positive = sorted(units, key=lambda i: (i * 2654435761) % (1 << 32))
    # all features that any fit below may know
    inside = np.bincount(np.concatenate([distinct(np.concatenate(units[i])) for i in positive]), minlength=SPACE)
    known = np.flatnonzero(inside >= (1 if len(positive) < 2 * folds else 2)).astype(np.int32)
    copies = written(words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    every = words.join(copies, "doc_id", "left")
    rate = min(1.0, max_units / max(1, words.agg(F.sum("units")).first()[0]))
    counted = written(every.mapInArrow(_counted(known, rate), _COUNTED_DDL), "counted")
    sums = counted.where("kind <> 1").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (sums.column(c).to_numpy() for c in ("kind", "key", "n"))
    outside = np.zeros(SPACE)
    outside[key[kind == 0]] = np.round(n[kind == 0], 6)
    documents, pieces = (round(float(n[(kind == 2) & (key == k)].sum()), 6) for k in (0, 1))
    drawn = counted.where("kind = 1").select("key", "features").orderBy("key", "features").limit(2 * max_units).toArrow()
    place = drawn.column("key").to_numpy()
    lists = drawn.column("features").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    once = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[:max_units] if len(place) else []
    loose = [flat[ends[k] : ends[k + 1]] for k in once]
    if not loose:
        return None
    per_doc = max(1.0, pieces / documents)

    def learn(ids: list[int], share: float) -> tuple[np.ndarray, np.ndarray, float]:
        # a passage is one or two overlapping units
        return _learn({i: units[i] for i in ids}, outside, documents, loose, min(0.5, max(1e-4, 1.5 * share / per_doc)))

    def top(x: dict[int, list[np.ndarray]], model: tuple) -> np.ndarray:
        return np.array([z.max() for z in _best(x, *model).values()])

    def spread(models: list[tuple], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels to try, and the histogram of all documents' scores between them."""
        high = [np.sort(_Rows(loose, m[0]).times(m[1]) + m[2])[-LEVELS:] for m in models]
        levels = np.unique(np.concatenate([*held, *high]))
        count, most = np.zeros(len(levels) + 1), np.full(len(levels) + 1, -np.inf)
        for r in every.mapInArrow(_binned(models, levels), _BINNED_DDL).groupBy("bin").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect():
            count[r["bin"]], most[r["bin"]] = round(r["n"], 6), r["most"]
        return levels, count, most

    share, high, threshold = min(0.05, limit), limit, np.inf
    for turn in range(2):
        held, models = [], []
        for k in range(folds if turn else 1):
            models.append(learn([i for n, i in enumerate(positive) if n % folds != k], share))
            held.append(top({i: units[i] for n, i in enumerate(positive) if n % folds == k}, models[-1]))
        threshold, share, high = _cut(np.concatenate(held), *spread(models, held), limit)
    model = learn(positive, share)
    return Model(_dense(*model[:2]), model[2], max(threshold, _level(high, *spread([model], [top(units, model)]))))


_SCORE_DDL = "doc_id bigint, score double"


def _scored(model: Model):
    weight, bias = model.weight, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, ids, _weight in _units(batches):
            at = np.flatnonzero(np.r_[True, u.owner[1:] != u.owner[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[u.owner[at]]), pa.array(np.maximum.reduceat(u.scores(weight, bias), at))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, words: DataFrame | None = None) -> DataFrame:
    """doc_id, score, flagged of each document (doc_id, text): the highest score of any of its units, and whether it reaches the threshold.

    The subject and every text part are read whole, decoded, quoted text included. Documents without words have a null score and are not
    flagged, as are all where there is no model. Documents sent twice count once. words: what ``worded`` makes of docs, where that is stored already.
    """
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score")).where(F.col("doc_id").isNotNull())
    if model is None:
        return every.distinct().withColumn("flagged", F.lit(False))
    found = (worded(docs) if words is None else words).mapInArrow(_scored(model), _SCORE_DDL)
    best = found.unionByName(every).groupBy("doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("flagged", F.coalesce(F.col("score") >= model.threshold, F.lit(False)))
