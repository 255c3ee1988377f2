"""Cuckoo filters in numpy: membership with deletions, in about two bytes a key."""

from __future__ import annotations

import struct

import numpy as np

from .shared import mix64

SLOTS, ROUNDS, LOAD = 4, 400, 0.84


class Full(Exception):
    """No place was found; build a larger filter from the exact table."""


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may stand in either of two buckets.

    Each distinct key is inserted once; only keys that were inserted may be deleted. No key that is held
    is ever missed; others are taken for held at a rate of about 8 / 65536 at full load.
    """

    def __init__(self, keys: int, seed: int = 7):
        self.bits = max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        self.table = np.zeros((1 << self.bits, SLOTS), np.uint16)
        self.rng = np.random.default_rng(seed)

    def _places(self, hi: np.ndarray, lo: np.ndarray):
        mark = (mix64(lo) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (mix64(hi) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix64(mark.astype(np.uint64) + np.uint64(0x51ED27)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, at = self._places(hi, lo)
        two = self._other(mark, at)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits into its buckets; returns which did not."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        first = np.flatnonzero(new)
        rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        free = self.table[bucket] == 0
        nth = np.cumsum(free, 1) - 1
        slot = free & (nth == rank[:, None])
        fits = slot.any(1)
        self.table[bucket[fits], slot[fits].argmax(1)] = mark[order][fits]
        left = np.zeros(len(at), bool)
        left[order[~fits]] = True
        return left

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        mark, at = self._places(hi, lo)
        left = self._fill(mark, at)
        mark, at = mark[left], self._other(mark[left], at[left])
        for _ in range(ROUNDS):
            if not len(mark):
                return
            left = self._fill(mark, at)
            mark, at = mark[left], at[left]
            if not len(mark):
                return
            # one key of each full bucket takes the place of another, which moves to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = self.rng.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot]
            self.table[at[one], slot] = mark[one]
            mark = mark.copy()
            at = at.copy()
            mark[one], at[one] = out, self._other(out, at[one])
        if len(mark):
            raise Full

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        mark, at = self._places(hi, lo)
        mark, at = self._take(mark, at)
        self._take(mark, self._other(mark, at))

    def _take(self, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Empty one slot for each mark that its bucket holds; returns the marks that were not found."""
        lost_mark, lost_at = [], []
        while len(mark):  # one key of each bucket at a time, as two may share bucket and mark
            _, one = np.unique(at, return_index=True)
            hit = self.table[at[one]] == mark[one, None]
            found = hit.any(1)
            self.table[at[one][found], hit[found].argmax(1)] = 0
            lost_mark.append(mark[one][~found])
            lost_at.append(at[one][~found])
            mark, at = np.delete(mark, one), np.delete(at, one)
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.uint16), *lost_mark]), np.concatenate([none, *lost_at])

    def dump(self) -> bytes:
        return struct.pack("<4sI", b"CKF1", self.bits) + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "CuckooFilter":
        out = cls(0)
        _, out.bits = struct.unpack_from("<4sI", blob)
        out.table = np.frombuffer(blob, "<u2", offset=8).reshape(1 << out.bits, SLOTS).copy()
        return out

    @classmethod
    def holding(cls, hi: np.ndarray, lo: np.ndarray) -> "CuckooFilter":
        """A filter of distinct keys, made larger until all find a place."""
        size = len(hi)
        while True:
            out = cls(size)
            try:
                out.insert(hi, lo)
                return out
            except Full:
                size = 2 * size + SLOTS
