"""All registered queries."""

from __future__ import annotations

from coordlytics.plans import catalog_primitives, catalog_relations, catalog_streams
from coordlytics.plans.catalog import Entry


def all_entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in (catalog_primitives, catalog_relations, catalog_streams):
        clash = out.keys() & module.ENTRIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.ENTRIES)
    return out
