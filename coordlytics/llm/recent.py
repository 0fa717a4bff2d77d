"""A bounded memory of results in a Python worker."""

from __future__ import annotations


class Recent:
    """Two generations of at most ``limit`` entries: what is asked for again moves to the young one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, wanted: set) -> set:
        """What is not known of ``wanted``; the rest is in ``young`` afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        lacking = wanted - self.young.keys()
        for key in lacking & self.old.keys():
            self.young[key] = self.old[key]
        return lacking - self.young.keys()
