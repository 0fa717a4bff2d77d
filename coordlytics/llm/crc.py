"""CRC-32 of many byte spans at once, by a table over byte values and distances from the end.

The CRC is linear over GF(2): a byte's share depends on its value and on the number of bytes behind it
only. Shares of up to ``BLOCK`` distances are looked up and XORed per span; what the start value adds is a
constant of the length. Longer spans are cut into blocks counted from their end, whose values are folded
pairwise, each earlier one advanced by the bytes behind it. Nothing here depends on Spark.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64  # distances with a table of their own
CHUNK_BYTES = 1 << 20  # of spans that are looked up at once
START = np.uint32(0xFFFFFFFF)


def _byte_shares() -> np.ndarray:
    share = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        share = np.where(share & 1, (share >> 1) ^ np.uint32(0xEDB88320), share >> 1)
    return share


class SpanCrc:
    def __init__(self):
        last = _byte_shares()
        shares = [last]
        for _ in range(BLOCK - 1):
            shares.append(self._past_zero(shares[-1], last))
        self.last, self.shares = last, np.concatenate(shares)
        constants = [START]
        for _ in range(BLOCK):
            constants.append(self._past_zero(constants[-1:], last)[0])
        self.constants = np.array(constants, np.uint32)  # by length, before the final complement
        values = np.arange(256, dtype=np.uint32)
        step = np.stack([values << np.uint32(8 * k) for k in range(4)])
        for _ in range(BLOCK):
            step = self._past_zero(step, last)
        self.steps = [step]  # entry i: past BLOCK << i bytes

    @staticmethod
    def _past_zero(values, last: np.ndarray) -> np.ndarray:
        values = np.asarray(values, np.uint32)
        return (values >> np.uint32(8)) ^ last[values & np.uint32(255)]

    def _step(self, level: int) -> np.ndarray:
        while len(self.steps) <= level:
            self.steps.append(self._advanced(self.steps[-1], len(self.steps) - 1))
        return self.steps[level]

    def _advanced(self, values: np.ndarray, level: int) -> np.ndarray:
        step = self._step(level)
        out = step[0][values & np.uint32(255)]
        for k in range(1, 4):
            out = out ^ step[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The unsigned CRC-32 of data[start:end] for every span; spans may overlap, and may be empty."""
        length = end - start
        blocks = np.maximum((length + BLOCK - 1) // BLOCK, 1)
        if blocks.max(initial=1) == 1:
            return ~(self._short(data, start, end) ^ self.constants[length])
        owner = np.repeat(np.arange(len(start)), blocks)
        first = np.cumsum(blocks) - blocks
        behind = blocks[owner] - 1 - (np.arange(len(owner)) - first[owner])  # blocks behind this one
        stop = end[owner] - BLOCK * behind
        values = self._short(data, np.maximum(start[owner], stop - BLOCK), stop)
        level = 0
        while behind.max(initial=0):
            values = np.where(behind & 1, self._advanced(values, level), values)
            behind = behind >> 1
            heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (behind[1:] != behind[:-1])])
            values, owner, behind = np.bitwise_xor.reduceat(values, heads), owner[heads], behind[heads]
            level += 1
        return ~(values ^ self._constants(length))

    def _constants(self, length: np.ndarray) -> np.ndarray:
        out = self.constants[length % BLOCK]
        rest, level = length // BLOCK, 0
        while rest.max(initial=0):
            out = np.where(rest & 1, self._advanced(out, level), out)
            rest, level = rest >> 1, level + 1
        return out

    def _short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XOR of the shares of spans of at most ``BLOCK`` bytes."""
        out = np.zeros(len(start), np.uint32)
        filled = np.flatnonzero(end > start)
        upto = np.cumsum(end[filled] - start[filled])
        done = 0
        while done < len(filled):
            base = upto[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, base + CHUNK_BYTES, "right")))
            own = filled[done:stop]
            length = end[own] - start[own]
            heads = np.cumsum(length) - length
            inside = np.arange(int(length.sum())) - np.repeat(heads, length)
            away = np.repeat(length - 1, length) - inside
            read = data[inside + np.repeat(start[own], length)]
            out[own] = np.bitwise_xor.reduceat(self.shares[(away << 8) + read], heads)
            done = stop
        return out
