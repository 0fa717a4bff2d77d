"""Distinct word shingles of whole texts, as hashes, for a batch of rows."""

from __future__ import annotations

import numpy as np

from coordlytics.llm.words import Reader, Words, mixed


def shingle_sets(reader: Reader, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text d has the sorted distinct hashes first[d]:first[d + 1].

    A text of fewer words than ``width`` has its whole sequence as one shingle, one without words has none.
    """
    counts = words.counts
    every = reader.windows(words.hash, width)
    whole = mixed(reader.whole(words) ^ np.uint64(width))
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for d, n in enumerate(counts):
        if n >= width:
            own = np.unique(every[words.first[d]: words.first[d + 1] - width + 1])
            parts.append(own)
            sizes[d] = len(own)
        elif n:
            parts.append(whole[d: d + 1])
            sizes[d] = 1
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first
