"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch at once.

A word is a maximal run of bytes that are no separators. Hashes are position-independent
polynomials over a random byte alphabet, finished by a mixer; equal words have equal hashes
in every process. Nothing here depends on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # texts are worked on in slices of about this size; a longer text is a slice of its own
#: Slices for Reader, which holds about a hundred bytes for each byte of a slice; idle Python workers keep that much.
READ_BYTES = 512 << 10
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASE = 0xD1342543DE82EF95 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _alphabet(seed: int) -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def white_space() -> np.ndarray:
    """Space, tab, line feed, vertical tab, form feed and carriage return."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def folded(alphabet: np.ndarray) -> np.ndarray:
    """The alphabet with A-Z as a-z."""
    out = alphabet.copy()
    out[65:91] = alphabet[97:123]
    return out


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))  # a task of few words needs no table for a whole slice

            def powers(b):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Words of several texts: word k is bytes start[k]:end[k]; text d has words first[d]:first[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    sums: np.ndarray  # of the hashed bytes, for hashes of parts of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Reader:
    """Splits and hashes texts. ``separators`` and ``fold`` say what a word is."""

    def __init__(self, separators: np.ndarray | None = None, fold: bool = False, seed: int = 1):
        self.separators = white_space() if separators is None else separators
        self.alphabet = folded(_alphabet(seed)) if fold else _alphabet(seed)
        self.powers = Powers(BASE)
        self.window_powers = Powers(WINDOW_BASE)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        n, docs = len(data), len(offsets) - 1
        inside = ~self.separators[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        tails = offsets[1:][np.diff(offsets) > 0] - 1
        begins[heads] = inside[heads]
        ends[tails] = inside[tails]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = self.powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.alphabet[data] * up[:n], out=sums[1:])
        hashes = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, offsets) if docs else np.zeros(1, np.int64)
        return Words(data, offsets, start, end, first.astype(np.int64), hashes, sums)

    def beginnings(self, words: Words, width: int) -> np.ndarray:
        """Hash of the first ``width`` bytes of every word, of the whole word if it is shorter."""
        _, down = self.powers.upto(len(words.data) + 1)
        end = np.minimum(words.end, words.start + width)
        return mixed((words.sums[end] - words.sums[words.start]) * down[words.start] + np.uint64(width))

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hash of every run of ``width`` neighbouring entries, text borders not regarded."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.uint64)
        up, down = self.window_powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])

    def whole(self, words: Words, salt: int = 0) -> np.ndarray:
        """One hash for the word sequence of each text."""
        up, down = self.window_powers.upto(len(words.hash) + 1)
        values = mixed(words.hash + np.uint64(salt)) if salt else words.hash
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        a, b = words.first[:-1], words.first[1:]
        return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over whole texts, about ``limit`` bytes each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop, data[offsets[row]: offsets[stop]], (offsets[row: stop + 1] - offsets[row])
        row = stop
