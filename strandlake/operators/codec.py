"""Huffman codes, integer codes, and lossless encoding of records and sequences."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.sources.fastx import SUPER_BLOCK


def code_lengths(counts: dict) -> dict:
    """Lengths of a Huffman code; symbols with count 0 have none, a single symbol has one bit. Of equal weights the earlier symbol goes first."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items())) if n > 0]
    depth = {s: 0 for _, _, (s,) in heap}
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return depth


def canonical(lengths: dict) -> dict:
    """symbol -> code as a string of bits, by length and then symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = format(code, f"0{n}b"), n
        code += 1
    return out


def huffman_codes(counts: DataFrame, by: list[str], sym: str, n: str) -> DataFrame:
    """by, sym, code of a canonical Huffman code per group; counts come aggregated, so a group has at most one row a symbol. Null symbols have no code."""
    names = [*by, sym]
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in names) + ", code string"

    def run(pdf):
        code = canonical(code_lengths(dict(zip(pdf[sym], pdf[n]))))
        out = pdf.drop_duplicates(sym)[names].copy()
        out["code"] = [code.get(s) for s in out[sym]]
        return out[out["code"].notna()]

    rows = counts.where(F.col(sym).isNotNull()).groupBy(*by, sym).agg(F.sum(n).alias(n))
    return rows.groupBy(*by).applyInPandas(run, schema)


def unary(n: int) -> str:
    return "1" * n + "0"


def read_unary(bits: str, at: int = 0) -> tuple[int, int]:
    end = bits.index("0", at)
    return end - at, end + 1


def gamma(n: int) -> str:
    """Elias gamma of n >= 1."""
    b = format(n, "b")
    return "0" * (len(b) - 1) + b


def read_gamma(bits: str, at: int = 0) -> tuple[int, int]:
    first = bits.index("1", at)
    end = first + (first - at) + 1
    return int(bits[first:end], 2), end


def low_high(n: int, low: int) -> str:
    """n in unary of what is above ``low`` bits, and these."""
    return unary(n >> low) + (format(n & ((1 << low) - 1), f"0{low}b") if low else "")


def read_low_high(bits: str, low: int, at: int = 0) -> tuple[int, int]:
    high, at = read_unary(bits, at)
    return high << low | int(bits[at : at + low] or "0", 2), at + low


def truncated_binary(x: int, n: int) -> str:
    """x of 0 to n - 1 in floor(log2 n) bits or one more."""
    k = n.bit_length() - 1
    short = (1 << (k + 1)) - n
    if x < short:
        return format(x, f"0{k}b") if k else ""
    return format(x + short, f"0{k + 1}b")


def read_truncated(bits: str, at: int, n: int) -> tuple[int, int]:
    k = n.bit_length() - 1
    short = (1 << (k + 1)) - n
    x = int(bits[at : at + k] or "0", 2)
    if x < short:
        return x, at + k
    return int(bits[at : at + k + 1], 2) - short, at + k + 1


def interpolative(values: list[int], low: int, high: int) -> str:
    """Increasing numbers in low..high: the middle one within what its neighbours leave, then both halves."""
    if not values:
        return ""
    m = len(values) // 2
    lo, hi = low + m, high - (len(values) - 1 - m)
    return truncated_binary(values[m] - lo, hi - lo + 1) + interpolative(values[:m], low, values[m] - 1) + interpolative(values[m + 1 :], values[m] + 1, high)


def read_interpolative(bits: str, n: int, low: int, high: int, at: int = 0) -> tuple[list[int], int]:
    if not n:
        return [], at
    m = n // 2
    lo, hi = low + m, high - (n - 1 - m)
    x, at = read_truncated(bits, at, hi - lo + 1)
    x += lo
    left, at = read_interpolative(bits, m, low, x - 1, at)
    right, at = read_interpolative(bits, n - 1 - m, x + 1, high, at)
    return [*left, x, *right], at


def _numbers(a: list[int]) -> bytes:
    return np.array(a, "<i8").tobytes()


def huffman_pack(data: bytes) -> tuple[bytes, bytes]:
    """256 code lengths, and the bits of all bytes in a row. The bits are looked up and laid out side by side."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return bytes(256), b""
    lengths = code_lengths(Counter(data))
    codes = canonical(lengths)
    size, value = np.zeros(256, np.int64), np.zeros(256, np.uint64)
    for s, c in codes.items():
        size[s], value[s] = len(c), int(c, 2)
    n = size[b]
    start = np.cumsum(n) - n
    bits = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max())):
        has = n > k
        bits[start[has] + k] = (value[b[has]] >> (n[has] - 1 - k).astype(np.uint64)) & np.uint64(1)
    return size.astype(np.uint8).tobytes(), np.packbits(bits).tobytes()


def huffman_unpack(lengths: bytes, packed: bytes, n: int) -> bytes:
    """The n bytes of huffman_pack. Where each code would end is known for all bit places at once; only the walk from code to code is a loop."""
    codes = canonical({s: k for s, k in enumerate(lengths) if k})
    if not n:
        return b""
    longest = max(map(len, codes.values()))
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    bits = np.r_[bits, np.zeros(longest, np.uint8)].astype(np.int64)
    sym, size, ahead = np.zeros(len(bits), np.uint8), np.ones(len(bits), np.int64), np.zeros(len(bits), np.int64)
    by = {}
    for s, c in codes.items():
        by.setdefault(len(c), {})[int(c, 2)] = s
    for k in range(1, longest + 1):
        m = len(bits) - k + 1
        ahead[:m] = ahead[:m] * 2 + bits[k - 1 : k - 1 + m]
        for v, s in by.get(k, {}).items():
            hit = np.flatnonzero(ahead[:m] == v)
            sym[hit], size[hit] = s, k
    at, step, where = 0, size.tolist(), []
    for _ in range(n):
        where.append(at)
        at += step[at]
    return sym[where].tobytes()


_DNA = np.full(256, 255, np.uint8)
_DNA[list(b"ACGT")] = range(4)


def dna_pack(seq: bytes) -> tuple[bytes, list[int], bytes]:
    """Two bits a letter, and places and letters of all others (as A in the bits)."""
    b = np.frombuffer(seq, np.uint8)
    code = _DNA[b]
    odd = np.flatnonzero(code == 255)
    code = np.where(code == 255, 0, code)
    code = np.r_[code, np.zeros(-len(code) % 4, np.uint8)].reshape(-1, 4)
    return (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8).tobytes(), odd.tolist(), b[odd].tobytes()


def dna_unpack(packed: bytes, odd: list[int], letters: bytes, n: int) -> bytes:
    b = np.frombuffer(packed, np.uint8)
    code = np.stack([b >> 6 & 3, b >> 4 & 3, b >> 2 & 3, b & 3], 1).ravel()[:n]
    out = np.frombuffer(b"ACGT", np.uint8)[code]
    out[odd] = np.frombuffer(letters, np.uint8)
    return out.tobytes()


def _framed(parts: list[bytes]) -> bytes:
    """Parts with their number and sizes before them."""
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unframed(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at = np.r_[0, np.cumsum(np.frombuffer(data, "<i8", n, 8))] + 8 * (n + 1)
    return [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


SEPARATED = r"([ ._,=:/\-])"
NUMBER = r"0|[1-9][0-9]{0,17}"


def _column(values: list[str]) -> bytes:
    """A title field after a sign for how it is kept: one value (C), numbers as differences to the one before (N), or text (T)."""
    import re
    import zlib

    if len(set(values)) == 1:
        return b"C" + values[0].encode("utf-8", "surrogatepass")
    if all(re.fullmatch(NUMBER, v) for v in values):
        return b"N" + zlib.compress(np.diff(np.array(list(map(int, values)), np.int64), prepend=0).astype("<i8").tobytes(), 6)
    return b"T" + zlib.compress("\n".join(values).encode("utf-8", "surrogatepass"), 6)


def pack_titles(titles: list[str | None]) -> bytes:
    """Titles field by field where all have the same separators, else whole. Separators are kept once."""
    import re
    import zlib

    split = [None if t is None or "\n" in t else re.split(SEPARATED, t) for t in titles]
    if split and None not in split and len({tuple(x[1::2]) for x in split}) == 1:
        return b"F" + _framed([_numbers([len(titles)]), "".join(split[0][1::2]).encode(), *(_column([x[k] for x in split]) for k in range(0, len(split[0]), 2))])
    return b"T" + zlib.compress("\n".join("\0" if x is None else "\1" + x.replace("\\", "\\\\").replace("\n", "\\n") for x in titles).encode("utf-8", "surrogatepass"), 6)


def unpack_titles(data: bytes) -> list[str | None]:
    import re
    import zlib

    if data[:1] == b"T":
        plain = lambda x: None if x == "\0" else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x[1:])
        return [plain(x) for x in zlib.decompress(data[1:]).decode("utf-8", "surrogatepass").split("\n")]
    count, marks, *columns = _unframed(data[1:])
    n = int(np.frombuffer(count, "<i8")[0])

    def column(raw: bytes) -> list[str]:
        if raw[:1] == b"C":
            return [raw[1:].decode("utf-8", "surrogatepass")] * n
        if raw[:1] == b"N":
            return [str(x) for x in np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), "<i8")).tolist()]
        return zlib.decompress(raw[1:]).decode("utf-8", "surrogatepass").split("\n")

    fields = [column(c) for c in columns]
    return ["".join(x + m for x, m in zip(row, [*marks.decode(), ""])) for row in zip(*fields)]


def quality_method(quals: list[bytes]) -> int:
    """2 run lengths, 1 plain, 3 plain without trailing #, by the first record of each block of 32; the rule of profile.encoder_choice."""
    raw = th = rle = blocks = 0
    for k in range(0, len(quals), 32):
        q = next((x for x in quals[k : k + 32] if x), b"")
        if q:
            runs = 1 + sum(a != b for a, b in zip(q, q[1:]))
            raw, th, rle, blocks = raw + len(q), th + max(len(q.rstrip(b"#")) - 1, 0), rle + runs - q.endswith(b"#"), blocks + 1
    return 2 if th > 1.25 * rle else 1 if raw - th < 3 * blocks else 3


def pack_quals(quals: list[bytes]) -> tuple[int, bytes]:
    """The method and the qualities: by place, each place in a Huffman code of its own, or as letters and run lengths in a code each."""
    import zlib

    method = quality_method(quals)
    if method == 2:
        flat = np.frombuffer(b"".join(quals), np.uint8)
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(flat)])
        times = -(-size // 255)
        letters = np.repeat(flat[starts], times)
        part = np.full(int(times.sum()), 255)
        part[np.cumsum(times) - 1] = size - 255 * (times - 1)
        return method, zlib.compress(_framed([_numbers([len(letters)]), *huffman_pack(letters.tobytes()), *huffman_pack(part.astype(np.uint8).tobytes())]), 1)
    kept = [q.rstrip(b"#") for q in quals] if method == 3 else quals
    size = np.array([len(q) for q in kept], np.int64)
    flat = np.frombuffer(b"".join(kept), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    by = flat[np.argsort(place, kind="stable")]
    cuts = np.r_[0, np.cumsum(np.bincount(place))] if len(flat) else [0]
    columns = [huffman_pack(by[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    return method, zlib.compress(_framed([size.astype("<i4").tobytes() if method == 3 else b"", *(x for c in columns for x in c)]), 1)


def unpack_quals(method: int, data: bytes, size: np.ndarray) -> list[bytes]:
    """The qualities of pack_quals, whose lengths are ``size``."""
    import zlib

    at = np.r_[0, np.cumsum(size)]
    if method == 2:
        count, *codes = _unframed(zlib.decompress(data))
        n = int(np.frombuffer(count, "<i8")[0])
        flat = np.repeat(np.frombuffer(huffman_unpack(*codes[:2], n), np.uint8), np.frombuffer(huffman_unpack(*codes[2:], n), np.uint8))
    else:
        kept, *codes = _unframed(zlib.decompress(data))
        kept = np.frombuffer(kept, "<i4").astype(np.int64) if method == 3 else size
        flat = np.full(int(size.sum()), ord("#"), np.uint8)
        for k, (lengths, packed) in enumerate(zip(codes[::2], codes[1::2])):
            rows = np.flatnonzero(kept > k)
            flat[at[rows] + k] = np.frombuffer(huffman_unpack(lengths, packed, len(rows)), np.uint8)
    flat = flat.tobytes()
    return [flat[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


ENCODED = "sb_id bigint, records int, first_rec bigint, last_rec bigint, method int, rec_nos binary, titles binary, plus binary, seq_sizes binary, seq binary, odd_at binary, odd binary, qual_sizes binary, qual binary"


def encode_fastq(reads: DataFrame) -> DataFrame:
    """One row a super-block of 16,384 record numbers, its columns kept apart: titles by field, letters in two bits with the others listed, and
    qualities by the method that suits the super-block (quality_method). reads: rec_no, title, seq, plus, qual; nulls come back as nulls,
    anything as it was. records, first_rec, last_rec and method are the super-block's header, by which blocks are found without decoding.

    A super-block is bounded, so it is one group of one task.
    """
    import zlib

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rec_no", kind="stable")

        def column(c):
            raw = [None if x is None else x.encode("utf-8", "surrogatepass") for x in pdf[c]]
            return _numbers([-1 if x is None else len(x) for x in raw]), [x or b"" for x in raw]

        seq_sizes, seq = column("seq")
        qual_sizes, qual = column("qual")
        packed, odd_at, odd = dna_pack(b"".join(seq))
        method, bits = pack_quals(qual)
        no = pdf["rec_no"].to_numpy()
        row = [int(no[0] // SUPER_BLOCK), len(pdf), int(no[0]), int(no[-1]), method, zlib.compress(_numbers(list(np.diff(no, prepend=0))), 6), pack_titles(list(pdf["title"])), pack_titles(list(pdf["plus"])), zlib.compress(seq_sizes, 6), packed, zlib.compress(_numbers(odd_at), 6), odd, zlib.compress(qual_sizes, 6), bits]
        return pd.DataFrame([row], columns=[c.split()[0] for c in ENCODED.split(", ")])

    rows = reads.select(F.col("rec_no").cast("bigint").alias("rec_no"), "title", "seq", "plus", "qual").where(F.col("rec_no").isNotNull())
    return rows.groupBy(F.floor(F.col("rec_no") / SUPER_BLOCK)).applyInPandas(run, ENCODED)


def block_index(encoded: DataFrame) -> DataFrame:
    """sb_id, first_rec, last_rec, records, method: the headers of encoded super-blocks; nothing else is read."""
    return encoded.select("sb_id", "first_rec", "last_rec", "records", "method")


DECODED = "rec_no bigint, title string, seq string, plus string, qual string"
_DECODED = pa.schema([("rec_no", pa.int64()), *((c, pa.string()) for c in ("title", "seq", "plus", "qual"))])


def decode_fastq(encoded: DataFrame) -> DataFrame:
    """The records that encode_fastq took."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda b: np.frombuffer(zlib.decompress(b), "<i8")
        text = lambda x: x.decode("utf-8", "surrogatepass")

        for b in batches:
            for row in b.to_pylist():
                size, qsize = numbers(row["seq_sizes"]), numbers(row["qual_sizes"])
                seq = dna_unpack(row["seq"], numbers(row["odd_at"]).tolist(), row["odd"], int(size[size > 0].sum()))
                at = np.r_[0, np.cumsum(np.maximum(size, 0))].tolist()
                seqs = [None if n < 0 else text(seq[a : a + n]) for a, n in zip(at, size.tolist())]
                quals = [None if n < 0 else text(q) for q, n in zip(unpack_quals(row["method"], row["qual"], np.maximum(qsize, 0)), qsize.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(numbers(row["rec_nos"]))), *(pa.array(x, pa.string()) for x in (unpack_titles(row["titles"]), seqs, unpack_titles(row["plus"]), quals))], schema=_DECODED)

    return encoded.mapInArrow(run, DECODED)


def extract_records(encoded: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records by number (wanted: rec_no): only the super-blocks that hold one are decoded."""
    ids = wanted.select(F.col("rec_no").cast("bigint").alias("rec_no")).distinct()
    blocks = ids.select(F.floor(F.col("rec_no") / SUPER_BLOCK).alias("sb_id")).distinct()
    return decode_fastq(encoded.join(blocks, "sb_id", "left_semi").select(*encoded.columns)).join(ids, "rec_no", "left_semi")


FASTA_ENCODED = "records int, headers binary, layout binary, letters bigint, cases binary, seq binary, odd_at binary, odd binary"


def encode_fasta(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """key and the parts of a FASTA text: header lines, line lengths and ends, runs of lower case, letters in two bits, other letters as runs. Lossless for any text."""
    import zlib

    names = [c.split()[0] for c in FASTA_ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(text).to_pylist():
                heads, layout, body = [], [], []
                for line in t.split("\n"):
                    end = line[len(line.rstrip("\r")) :]
                    line = line[: len(line) - len(end)]
                    if line.startswith(">"):
                        heads.append(line)
                        layout.append(-1)
                    else:
                        body.append(line)
                        layout.append(len(line.encode()))
                    layout.append(len(end))
                raw = "".join(body).encode()
                a = np.frombuffer(raw, np.uint8)
                low = (a >= 97) & (a <= 122)
                up = np.where(low, a - 32, a).astype(np.uint8)
                turns = np.flatnonzero(np.diff(np.r_[False, low, False].astype(np.int8)))
                packed, odd_at, odd = dna_pack(up.tobytes())
                at = np.array(odd_at, np.int64)
                o = np.frombuffer(odd, np.uint8)
                first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (o[1:] != o[:-1])]) if len(at) else at
                runs = np.r_[at[first], np.diff(np.r_[first, len(at)])]
                rows.append([len(heads), zlib.compress("\n".join(heads).encode(), 6), zlib.compress(_numbers(layout), 6), len(raw), zlib.compress(_numbers(list(turns)), 6), packed, zlib.compress(_numbers(list(runs)), 6), o[first].tobytes() if len(at) else b""])
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(list(c), kinds[k.split()[1]]) for c, k in zip(cols, FASTA_ENCODED.split(", ")))], names=[key, *names])

    rows = blocks.select(key, text).where(F.col(text).isNotNull())
    return rows.mapInArrow(run, f"`{key}` {blocks.schema[key].dataType.simpleString()}, {FASTA_ENCODED}")


def decode_fasta(encoded: DataFrame, key: str) -> DataFrame:
    """key, text of encode_fasta."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: np.frombuffer(zlib.decompress(x), "<i8")
        for b in batches:
            out = []
            for row in b.to_pylist():
                runs = numbers(row["odd_at"])
                start, size = runs[: len(runs) // 2], runs[len(runs) // 2 :]
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                raw = np.frombuffer(dna_unpack(row["seq"], at.tolist(), np.repeat(np.frombuffer(row["odd"], np.uint8), size).tobytes(), row["letters"]), np.uint8).copy()
                for x, y in numbers(row["cases"]).reshape(-1, 2).tolist():
                    raw[x:y] += 32
                raw, at, k = raw.tobytes(), 0, 0
                heads = zlib.decompress(row["headers"]).decode().split("\n")
                lines = []
                for n, end in numbers(row["layout"]).reshape(-1, 2).tolist():
                    if n < 0:
                        line, k = heads[k], k + 1
                    else:
                        line, at = raw[at : at + n].decode(), at + n
                    lines.append(line + "\r" * end)
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], names=[key, "text"])

    return encoded.mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
