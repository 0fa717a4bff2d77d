"""Token counts with a public tokenizer (operator 3).

A text is cut in front of every space that follows a character other than white space. The
tokenizer's own splitting pattern never joins a character to a following space and only looks ahead,
so no token crosses such a cut and none depends on what stands before it. Every distinct
piece of an Arrow batch is encoded once, in batches balanced by bytes, and only its length
is kept. Recent pieces are remembered by the Python worker up to a fixed number.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a text without any space is
one piece; special strings inside a text become special tokens, as by default; an
empty table gives an empty result; repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 300_000  # pieces kept by a worker
LONGEST_REMEMBERED = 64  # characters
ENCODE_BYTES = 256 << 10  # one call to the tokenizer
ROWS_BYTES = 4 << 20  # texts looked at together
UNEVEN = re.compile(r"\A\s|\s ")  # a space after white space, where no cut is made


def pieces(text: str) -> list[str]:
    """The text without its cuts: all but the first piece have lost their leading space."""
    parts = text.split(" ")
    if not UNEVEN.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        # an empty piece after the first stands for a lone space
        ends_in_space = out[-1][-1:].isspace() if out[-1] else True
        if ends_in_space:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def learn(self, unknown: list[str]) -> dict[str, int]:
        """Lengths of pieces, encoded in batches of about ENCODE_BYTES."""
        found, group, size = {}, [], 0
        for piece in chain(unknown, [None]):
            if group and (piece is None or size + len(piece) > ENCODE_BYTES):
                encoded = self.tokenizer.encode_batch(group, add_special_tokens=False)
                found.update(zip(group, map(len, encoded)))
                group, size = [], 0
            if piece is not None:
                group.append(piece)
                size += len(piece)
        return found

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [pieces(t) for t in texts]
        # a head keeps its own spelling; every other piece is looked up with its space
        heads = self.learn(list({s[0] for s in split}))
        rest = set(chain.from_iterable(s[1:] for s in split))
        fresh = self.learn([" " + p for p in rest if p not in self.known])
        self.known.update((p[1:], n) for p, n in fresh.items())
        out = [heads[s[0]] + sum(map(self.known.__getitem__, s[1:])) for s in split]
        for p in fresh:
            if len(p) > LONGEST_REMEMBERED:
                del self.known[p[1:]]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def by_bytes(texts: pa.Array, limit: int = ROWS_BYTES) -> Iterator[pa.Array]:
    """Neighbouring rows of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(texts):
        yield texts.slice(start)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer`` names a file for the tokenizers library that every executor has.
    """
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            tokens: list[int] = []
            for part in by_bytes(texts):
                tokens += own.counts([t or "" for t in part.to_pylist()])
            counted = pa.array(tokens, pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, counted, pc.greater(counted, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
