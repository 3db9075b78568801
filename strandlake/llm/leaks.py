"""Evaluation texts leaking into training text: winnowed word fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.letters import distinct
from strandlake.llm.mail import text_parts
from strandlake.llm.words import Words, least_of, tables

#: Up to so many different test fingerprints (16 MB) the corpus side is filtered by them where it is read; beyond, by the join alone.
FILTER_LIMIT = 2_000_000
#: Characters handled at once.
PIECE = 1_000_000

_DDL = "id bigint, h bigint, around binary"
_SCHEMA = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("around", pa.binary())])


def plain(text: str | None) -> list[str]:
    return [text] if text else []


def _fingerprints(span: int, gram: int, parts_of: Callable[[str | None], list[str]], wanted: np.ndarray | None):
    window, reach = span - gram + 1, span - gram

    def some(ids: list[int], texts: list[str], word: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = Words(texts, word, value)
        h = w.grams(gram)
        # a window of `window` grams is `span` words of one text
        least = least_of(h, window)
        n = len(least)
        least = distinct(least[w.text[:n] == w.text[span - 1 : span - 1 + n]])
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, h[least]), len(wanted) - 1)
            least = least[wanted[at] == h[least]] if len(wanted) else least[:0]
        if not len(least):
            return
        # the words that a shared span through this gram can reach; 0 beyond the text's ends
        place = least[:, None] + np.arange(-reach, span)[None, :]
        inside = (place >= 0) & (place < len(w.hash))
        place = np.clip(place, 0, len(w.hash) - 1)
        around = np.where(inside & (w.text[place] == w.text[least][:, None]), w.hash[place], np.uint64(0))
        rows = np.ascontiguousarray(around).astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[w.text[least]]), pa.array(h[least].view(np.int64)), pa.array([x.tobytes() for x in rows], pa.binary())], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, value = tables()
        for b in batches:
            ids, texts, size = [], [], 0
            for i, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                for t in parts_of(raw):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                if size > PIECE:
                    yield from some(ids, texts, word, value)
                    ids, texts, size = [], [], 0
            if texts:
                yield from some(ids, texts, word, value)

    return run


def _extends(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose words around the common gram agree for at least `span` words in a row."""
        reach = span - gram
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(len(b), -1) for c in ("x", "y"))
            same = (x == y) & (x != 0)
            left = np.cumprod(same[:, reach - 1 :: -1] if reach else same[:, :0], axis=1).sum(1)
            right = np.cumprod(same[:, reach:], axis=1).sum(1)
            ok = (right >= gram) & (left + right >= span)
            yield b.filter(pa.array(ok)).select(["doc_id", "item_id"])

    return run


def leaked(docs: DataFrame, items: DataFrame, span: int = 12, gram: int = 6, parts_of: Callable[[str | None], list[str]] = text_parts) -> DataFrame:
    """doc_id, item_id of each document (doc_id, text) that has ``span`` consecutive words of an item (item_id, text) in a row.

    Winnowing: of the ``span - gram + 1`` word grams in each ``span`` words the one with the smallest hash is kept, on either side, so every
    shared span has a kept gram in common. The fingerprints are joined, and each hit is extended word by word to both sides.
    Words are maximal runs of letters and digits, lower-cased; a document's are taken from each of ``parts_of`` its text by itself.
    Null, empty and shorter texts have no fingerprints. Rows with the same id count as one.
    """
    rows = lambda df, key: df.select(F.col(key).cast("bigint").alias("id"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    tests = rows(items, "item_id").mapInArrow(_fingerprints(span, gram, plain, None), _DDL).distinct()
    tests = tests.select(F.col("id").alias("item_id"), "h", F.col("around").alias("y"))
    hashes = [r[0] for r in tests.select("h").distinct().limit(FILTER_LIMIT + 1).collect()]
    small = len(hashes) <= FILTER_LIMIT
    wanted = np.sort(np.array(hashes, np.int64).view(np.uint64)) if small else None
    found = rows(docs, "doc_id").mapInArrow(_fingerprints(span, gram, parts_of, wanted), _DDL)
    found = found.select(F.col("id").alias("doc_id"), "h", F.col("around").alias("x"))
    pairs = found.join(tests, "h").select("doc_id", "item_id", "x", "y")
    return pairs.mapInArrow(_extends(span, gram), "doc_id bigint, item_id bigint").distinct()
