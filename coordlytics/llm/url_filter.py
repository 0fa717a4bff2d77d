"""Verdicts on URLs by a trie over reversed host labels and path segments (operator 9).

The trie is built on the driver from the rules, which are configuration of at most
``MAX_RULES`` entries, and is broadcast. A URL walks it once: labels from the right, then
path segments; the deepest rule met wins, the longest path among the rules of one host.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; only
A-Z of the host are lower-cased; a port or user name stays part of the host and so keeps it
from matching; an empty table gives an empty result; repeated rows stay; two rules with
the same host and path are an error. Other columns of the input are passed through by
`judge` only if asked for, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000  # about 0.5 GB as a trie; more rules than this do not belong in a broadcast
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    partial: dict[str, Rule] = field(default_factory=dict)  # rules that end inside the next segment


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host up to the first of / ? # after the first ://, path up to ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def build(rules: Iterable[Rule]) -> Node:
    root, count = Node(), 0
    for rule in rules:
        count += 1
        if count > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        node = root
        for label in reversed(rule.host.translate(LOWER).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if last in node.partial:
            raise ValueError(f"rule given twice: {rule.text}")
        node.partial[last] = rule
    return root


def _on_path(node: Node, path: str) -> Rule | None:
    """The longest rule below a host's node whose path is a prefix of ``path``."""
    best, segments = None, path.split("/")
    for i, segment in enumerate(segments):
        if node.partial:
            for size in range(len(segment) + 1):
                best = node.partial.get(segment[:size], best)
        if i + 1 < len(segments):
            node = node.segments.get(segment)
            if node is None:
                break
    return best


def match(root: Node, host: str, path: str) -> Rule | None:
    best, node = None, root
    if host:
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            found = _on_path(node, path)
            if found and (best is None or len(found.text) >= len(best.text)):
                best = found
    return best


def judge(pages: DataFrame, rules: Iterable[Rule], keep: tuple[str, ...] = (), url: str = "url",
          otherwise: str = "allow") -> DataFrame:
    """The columns of ``keep``, then host, path, rule and verdict; ``otherwise`` where no rule fits."""
    shared = pages.sparkSession.sparkContext.broadcast(build(rules))
    chosen = pages.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{url}`").cast("string").alias("__url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for batch in batches:
            out = []
            for text in batch.column(len(keep)).to_pylist():
                host, path = split_url(text)
                host = host.translate(LOWER)
                rule = match(root, host, path)
                out.append((host, path, rule and rule.text, rule.verdict if rule else otherwise))
            added = [pa.array([r[i] for r in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *added], [*keep, "host", "path", "rule", "verdict"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kept}host string, path string, rule string, verdict string")
