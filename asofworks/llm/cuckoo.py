"""A cuckoo filter over 64-bit hashes, as one numpy table that a shard can ship as bytes."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insertion, look-up and deletion.

    An inserted key is always found. A key that was never inserted is found with
    probability of about 2 * SLOTS / 65535. Only keys that were inserted may be deleted.
    """

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.85 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        #: Keys that found no slot after long displacement; the filter stays exact on insertion.
        self.overflow: dict[tuple[int, int], int] = {}

    @classmethod
    def from_bytes(cls, data: bytes, spare: list[tuple[int, int, int]] = ()) -> CuckooFilter:
        f = cls.__new__(cls)
        f.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        f.overflow = {(a, b): n for a, b, n in spare}
        return f

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        tag = np.maximum(keys >> np.uint64(48), np.uint64(1))
        one = _mix(keys) & mask
        return tag.astype(np.uint16), one.astype(np.int64), (one ^ (_mix(tag) & mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Whole arrays go to free slots of their first and then of their second bucket; the few keys left displace others."""
        tags, ones, twos = self._places(keys)
        left = np.arange(len(tags))
        for places in (ones, twos):
            order = left[np.argsort(places[left], kind="stable")]
            at = places[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slots = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[at[fits], slots] = tags[order[fits]]
            left = order[~fits]
        if len(left):
            self._displace(tags[left], ones[left])

    def _displace(self, tags: np.ndarray, ones: np.ndarray) -> None:
        mask = len(self.table) - 1
        jump = (_mix(np.arange(1 << 16, dtype=np.uint64)) & np.uint64(mask)).astype(np.int64)
        table = self.table
        for t, at in zip(tags.tolist(), ones.tolist(), strict=True):
            for turn in range(500):
                slot = (turn + t) % SLOTS
                t, table[at, slot] = int(table[at, slot]), t
                if not t:
                    break
                at = int(at ^ jump[t])
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = t
                    break
            else:
                key = (t, min(at, int(at ^ jump[t])))
                self.overflow[key] = self.overflow.get(key, 0) + 1

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        tags, ones, twos = self._places(keys)
        found = (self.table[ones] == tags[:, None]).any(1) | (self.table[twos] == tags[:, None]).any(1)
        if self.overflow:
            found |= np.array([(t, min(i, j)) in self.overflow for t, i, j in zip(tags.tolist(), ones.tolist(), twos.tolist(), strict=True)])
        return found

    def delete(self, keys: np.ndarray) -> None:
        tags, ones, twos = self._places(keys)
        for t, i, j in zip(tags.tolist(), ones.tolist(), twos.tolist(), strict=True):
            for at in (i, j):
                hit = np.flatnonzero(self.table[at] == t)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
            else:
                key = (t, min(i, j))
                if self.overflow.get(key):
                    self.overflow[key] -= 1
                    if not self.overflow[key]:
                        del self.overflow[key]
