"""The same results by plain loops, for small tables."""

from __future__ import annotations

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    own = words(text)
    covered = set()
    runs = {}
    for i in range(len(own) - 4):
        runs.setdefault(tuple(own[i:i + 5]), []).append(i)
    for starts in runs.values():
        if len(starts) > 1:
            covered.update(p for i in starts for p in range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered))


def without_repeats(texts, span):
    """(words, removed, digest, kept words) of each text."""
    split = [words(t) for t in texts]
    places = {}
    for d, own in enumerate(split):
        for i in range(len(own) - span + 1):
            places.setdefault(tuple(own[i:i + span]), []).append((d, i))
    gone = [set() for _ in split]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + span))
    out = []
    for own, lost in zip(split, gone):
        kept = [w for i, w in enumerate(own) if i not in lost]
        out.append((len(own), len(lost), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def components(n, links):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    own = words(fold(text))
    if not own:
        return set()
    return {tuple(own[i:i + width]) for i in range(max(1, len(own) - width + 1))}


def near_duplicates(texts, width, percent):
    """(shingles, root position) of each text."""
    sets = [shingles(t, width) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(len(s), r) for s, r in zip(sets, components(len(sets), links))]


def cosine_links(vectors, labels, cosine):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = []
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if usable(a, labels[i]) and usable(b, labels[j]) and labels[i] == labels[j] and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b))
                if dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)) >= cosine:
                    out.append((i, j))
    return out
