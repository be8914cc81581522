"""A cuckoo filter over 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Rounds of moving fingerprints about before a filter counts as full.
ROUNDS = 200


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


class Cuckoo:
    """Holds a 16-bit fingerprint per inserted key, in one of two buckets of four slots; zero is a free slot.

    Keys are distinct 64-bit values; a key is inserted once and may be removed once. `might_hold` has no false negatives.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of `keys`, at most about four fifths full."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / SLOTS / 0.8))))
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (_mix(mark) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        return ((self.table[at] == mark[:, None]) | (self.table[self._other(mark, at)] == mark[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add all `keys`; False, with the filter unchanged, if they don't fit."""
        before = self.table.copy()
        mark, at = self._places(keys)
        rng = np.random.default_rng(7)
        for _ in range(ROUNDS):
            for _ in range(2):
                if not len(mark):
                    return True
                order = np.argsort(at, kind="stable")
                mark, at = mark[order], at[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                free = self.table[at] == 0
                fits = rank < free.sum(1)
                # the rank-th free slot of the bucket
                slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
                self.table[at[fits], slot[fits]] = mark[fits]
                mark, at = mark[~fits], at[~fits]
                at = self._other(mark, at)
            if not len(mark):
                return True
            lead = np.unique(at, return_index=True)[1]  # one key moves into each full bucket, one fingerprint moves out
            slot = rng.integers(0, SLOTS, len(lead))
            out = self.table[at[lead], slot].copy()
            self.table[at[lead], slot] = mark[lead]
            mark[lead] = out
            at[lead] = self._other(out, at[lead])
            gone = mark == 0
            mark, at = mark[~gone], at[~gone]
        self.table = before
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key; the keys must be in the filter."""
        mark, at = self._places(keys)
        other = self._other(mark, at)
        for m, a, b in zip(mark, at, other, strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == m)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
