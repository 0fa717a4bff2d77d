"""SentencePiece encoding and decoding (operator 8).

An Aho-Corasick automaton over the pieces reads a text once; at every position its output links
name all pieces that end there, and each is tried on the best segmentation up to where it begins.
For unigram models that is Viterbi: the best sum of scores wins. Models of the BPE kind do not maximise a
sum; there a piece extends the segmentation in front of it only if merging the last two pieces' text
by rank gives back just these two, which holds for exactly one piece at each position. Either way
the pass is linear and gives the segmentation that the model defines.

Texts are cut in front of white space where no piece can span the cut; each distinct part is encoded
once per batch, and recent ones are remembered by the Python worker up to a fixed number.

Defined cases: a null or empty text has no pieces and decodes to an empty text; characters
outside the model become bytes where the model has them, else one unknown piece per run; control
pieces inside a text are ordinary characters; repeated rows stay; an empty table gives an empty
result; of the input only id and text are read, unless columns are to be carried in a struct.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.recent import Recent

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
PAIRS_REMEMBERED = 1_000_000
ROWS_BYTES = 1 << 20  # of text whose parts are worked on at once; as strings they take over twenty times as much


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at: at + size]
            at += size


class Model:
    """Pieces with scores and kinds, and how texts are prepared."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True, squeeze: bool = False):
        import ahocorasick

        self.pieces, self.kind, self.prefix, self.squeeze = pieces, kind, prefix, squeeze
        self.score = [s for _, s, _ in pieces]
        self.rank = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.lowest = min((pieces[i][1] for i in self.rank.values()), default=0.0) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.rank.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.divides = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.spelled = [
            b"" if k in (CONTROL,) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.known = Recent(REMEMBERED)
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Model:
        pieces: list[tuple[str, float, int]] = []
        kind, prefix, squeeze = UNIGRAM, True, True
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("only models without a character map are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        return cls(pieces, kind, prefix, squeeze)

    # --- encoding of one part ---------------------------------------------------------------

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: the best-ranked neighbours are merged first, the leftmost of equals."""
        symbols, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int):
            right = after[left]
            if right < len(symbols):
                joined = symbols[left] + symbols[right]
                i = self.rank.get(joined)
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], left, right, joined))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if symbols[left] + symbols[right] != joined or not symbols[left] or not symbols[right] or after[left] != right:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return list(chain.from_iterable(self._ids(s) for s in symbols if s))

    def _ids(self, symbol: str) -> list[int]:
        i = self.rank.get(symbol)
        if i is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in symbol.encode()]
        return [self.unknown]

    def _fit(self, last: int, piece: int) -> bool:
        """Whether BPE leaves ``piece`` behind ``last`` (-1: at the beginning, -2: an unknown character) as it is."""
        key = (last, piece)
        found = self.fits.get(key)
        if found is None:
            front = self.pieces[last][0] if last >= 0 else ""
            found = self.merged(front + self.pieces[piece][0]) == ([last, piece] if last >= 0 else [piece])
            if len(self.fits) >= PAIRS_REMEMBERED:
                self.fits.clear()
            self.fits[key] = found
        return found

    def by_rank(self, text: str) -> list[int]:
        """The BPE segmentation: for each position the one last piece that fits what stands before it."""
        n = len(text)
        last, start = [-3] * (n + 1), [0] * (n + 1)
        last[0] = -1
        fits, done = self.fits.get, 0
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # a position where no piece ended: an unknown character
                done += 1
                if last[done] == -3:
                    last[done], start[done] = -2, done - 1
            if last[end] != -3:
                continue
            front = last[end - size]
            fit = fits((front, piece))
            if self._fit(front, piece) if fit is None else fit:
                last[end], start[end] = piece, end - size
        for end in range(done + 1, n + 1):
            if last[end] == -3:
                last[end], start[end] = -2, end - 1
        return self._trace(text, last, start)

    def by_score(self, text: str) -> list[int]:
        """The segmentation with the best sum of scores; an unknown character costs more than any piece."""
        n = len(text)
        best, last, start = [-float("inf")] * (n + 1), [-2] * (n + 1), [0] * (n + 1)
        best[0], last[0] = 0.0, -1
        done = 0

        def settle(upto: int):
            nonlocal done
            while done < upto:
                done += 1
                alone = best[done - 1] + self.lowest
                if best[done] < alone:
                    best[done], last[done], start[done] = alone, -2, done - 1

        for end, (piece, size) in self.automaton.iter(text):
            settle(end)  # all before this position is final
            score = best[end + 1 - size] + self.score[piece]
            if score > best[end + 1]:
                best[end + 1], last[end + 1], start[end + 1] = score, piece, end + 1 - size
        settle(n)
        return self._trace(text, last, start)

    def _trace(self, text: str, last: list[int], start: list[int]) -> list[int]:
        parts, end = [], len(text)
        while end > 0:
            if last[end] >= 0:
                parts.append([last[end]])
            elif self.bytes:
                parts.append(self._ids(text[start[end]: end]))
            elif not parts or parts[-1] != [self.unknown]:
                parts.append([self.unknown])
            end = start[end]
        return list(chain.from_iterable(reversed(parts)))

    def part(self, text: str) -> list[int]:
        if self.kind == UNIGRAM:
            return self.by_score(text)
        # runs of spaces have pieces of equal rank, where the order of merging decides
        return self.merged(text) if text.startswith(2 * MARK) or text == MARK else self.by_rank(text)

    # --- whole texts ------------------------------------------------------------------------

    def prepared(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def parts(self, text: str) -> list[str]:
        """What is encoded by itself; a part with one mark in front of it has lost it."""
        if not text:
            return []
        if not self.divides:
            return [MARK + text]
        words = text.split(MARK)
        if words[0] == "" and "" not in (rest := words[1:]):
            return rest
        out, marks = ([MARK + words[0]] if words[0] else []), ""
        for word in words[1:]:
            marks += MARK
            if word:
                out.append(word if len(marks) == 1 else MARK + marks + word)
                marks = ""
        return [*out, MARK + marks] if marks else out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.parts(self.prepared(t)) for t in texts]
        fresh = self.known.missing(set(chain.from_iterable(split)))
        known = self.known.young
        for p in fresh:
            # a mark in front says that the rest is to be taken as it is
            known[p] = np.array(self.part(p[1:] if p[0] == MARK else MARK + p), np.int32).tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), np.int32) for s in split]
        for p in fresh:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.read(path)
    return _models[path]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // ROWS_BYTES, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def coded(docs: DataFrame, model_path: str, columns: list[str], text_column: str = "text") -> DataFrame:
    """``row`` (the given columns), ids, n_tokens, decoded_sha256 and round_trip of every row.

    ``model_path`` is a model file that every executor has. ``round_trip``: the decoded pieces are the text.
    """
    chosen = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            row = 0
            for texts in _slices(batch.column(1)):
                ids = own.encode(texts)
                decoded = [own.decode(i) for i in ids]
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                     pa.array(sizes), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                     pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_())],
                    ["row", "ids", "n_tokens", "decoded_sha256", "round_trip"])
                row += len(texts)

    row = chosen.schema["row"].dataType.simpleString()
    return chosen.mapInArrow(run, f"row {row}, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean")
