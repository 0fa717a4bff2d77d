"""What every catalog module shares: entries and the assembly of their independent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from coordlytics.plans.bindings import BASE, Tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named relations it refers to, directly or through others."""
    known = {**BASE, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, inside: str | None = None):
        for name in known:
            if name != inside and name not in ordered and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                need(known[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    own = body.lstrip()
    # a body with relations of its own continues the same list
    rest = ",\n" + own[len("with "):] if own.startswith("with ") else "\n" + own
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in ordered) + rest
