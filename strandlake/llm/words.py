"""Words of many texts at once, as hashes in NumPy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: The planes in which letters and digits are assigned.
TOP = 0x32400


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 if it is no letter or digit, else a hash of its lower case; made once a task."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(TOP)]
    word = np.fromiter(map(str.isalnum, chars), bool, TOP)
    low = np.arange(TOP, dtype=np.uint64)
    for i in np.flatnonzero(word):
        c = chars[i].lower()
        if len(c) == 1:
            low[i] = ord(c)
    return word, mix(low + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, base: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)].cumprod(dtype=np.uint64)[:n]


class Words:
    """Maximal runs of letters and digits, lower-cased, of a list of texts: hash and text number of each, in order."""

    def __init__(self, texts: Sequence[str], word: np.ndarray, value: np.ndarray):
        data = "\n".join(texts)
        code = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, TOP - 1)
        inside = np.r_[False, word[code], False]
        self.begin = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.end = np.flatnonzero(~inside[1:] & inside[:-1])
        size = self.end - self.begin
        n = int(size.max()) if len(size) else 0
        # the letters of all words in a row, and each one's place in its word
        letters = code[inside[1:-1]]
        first = np.r_[0, np.cumsum(size)]
        place = np.arange(len(letters)) - np.repeat(first[:-1], size)
        total = np.r_[np.uint64(0), (value[letters] * powers(n, 0x100000001B3)[place]).cumsum(dtype=np.uint64)]
        self.hash = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
        self.starts = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)][: len(texts)]
        self.text = np.searchsorted(self.starts, self.begin, "right") - 1

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each; those that go beyond a text are not told apart here."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C55) + self.hash[j : j + n]
        return mix(out)


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest of the w values from each, by doubling."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    least, span = np.arange(n), 1
    while span < w:
        step = min(span, w - span)
        a, c = least[: len(least) - step], least[step:]
        least = np.where(h[c] < h[a], c, a)
        span += step
    return least
