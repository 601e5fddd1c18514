"""A cuckoo filter over 128-bit keys that inserts, finds and deletes whole arrays of them."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8


class CuckooFilter:
    """A table of 16-bit fingerprints, four to a bucket; a key's fingerprint is in one of two buckets.

    No key that was inserted is missed; others are found by mistake about once in 8,000. A full table takes
    no more keys: ``insert`` then says so, and the table is built anew from the exact keys behind it.
    """

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        size = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        self.table = np.zeros((size, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, spare: float = 1.25) -> CuckooFilter:
        """A filter of these keys, with room for ``spare`` times as many; larger where some find no place."""
        room = spare * k1.size
        while True:
            f = cls(int(room))
            if f.insert(k1, k2):
                return f
            room *= 2

    @staticmethod
    def _marks(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return k1.view(np.uint64), np.maximum(marks, 1).astype(np.uint16)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return bucket ^ ((marks.astype(np.int64) * 0x5BD1E995) >> 3 & (len(self.table) - 1))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h, marks = self._marks(k1, k2)
        a = self._home(h)
        b = self._other(a, marks)
        return (self.table[a] == marks[:, None]).any(axis=1) | (self.table[b] == marks[:, None]).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray, rounds: int = 200) -> bool:
        """Put keys in, by rounds of evictions. False: some found no place, and the table is as it was."""
        h, marks = self._marks(k1, k2)
        before, t = self.table.copy(), self.table
        if int((t > 0).sum()) + h.size > 0.95 * t.size:
            return False
        bucket = self._home(h)
        rng = np.random.default_rng(len(t))
        for r in range(rounds):
            if not bucket.size:
                return True
            order = np.argsort(bucket, kind="stable")
            bucket, marks = bucket[order], marks[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            nth = np.arange(bucket.size) - np.repeat(first, np.diff(np.append(first, bucket.size)))
            used = (t[bucket] > 0).sum(axis=1)
            fits = used + nth < SLOTS
            # Slots fill from the front, and deletion closes gaps, so the next free slot is the number in use.
            t[bucket[fits], (used + nth)[fits]] = marks[fits]
            bucket, marks = bucket[~fits], marks[~fits]
            if r and bucket.size:
                one = np.concatenate(([True], bucket[1:] != bucket[:-1]))
                slot = rng.integers(0, SLOTS, int(one.sum()))
                marks[one], t[bucket[one], slot] = t[bucket[one], slot].copy(), marks[one]
            bucket = self._other(bucket, marks)
        self.table = before
        return not bucket.size

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> int:
        """Remove one fingerprint for each key, all of which were inserted; returns how many were there."""
        h, marks = self._marks(k1, k2)
        t, left = self.table, np.ones(h.size, bool)
        for alternative in (0, 1):
            todo = np.flatnonzero(left)
            while todo.size:
                bucket = self._home(h[todo])
                if alternative:
                    bucket = self._other(bucket, marks[todo])
                hit = t[bucket] == marks[todo][:, None]
                has = hit.any(axis=1)
                todo, bucket, hit = todo[has], bucket[has], hit[has]
                if not todo.size:
                    break
                _, one = np.unique(bucket, return_index=True)
                rows = t[bucket[one]]
                rows[np.arange(one.size), hit[one].argmax(axis=1)] = 0
                t[bucket[one]] = np.take_along_axis(rows, np.argsort(rows == 0, axis=1, kind="stable"), axis=1)
                left[todo[one]] = False
                todo = np.delete(todo, one)
        return int(h.size - left.sum())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())
