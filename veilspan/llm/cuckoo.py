"""Cuckoo filters over 64-bit hashes, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 200


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """16-bit fingerprints in two candidate buckets of four; a full table gets a larger one beside it.

    Every hash that was added and not removed is found; others are found with a chance of about
    ``8 / 65535`` per table.  Add a hash once, and remove only what was added.
    """

    def __init__(self, buckets: int = 64):
        self.tables = [np.zeros((buckets, SLOTS), np.uint16)]

    @staticmethod
    def for_size(keys: int) -> "CuckooFilter":
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.85 * SLOTS))))))

    @staticmethod
    def load(data: bytes) -> "CuckooFilter":
        out, at = CuckooFilter(1), 0
        out.tables = []
        while at < len(data):
            size = int.from_bytes(data[at:at + 4], "little")
            out.tables.append(np.frombuffer(data, "<u2", size * SLOTS, at + 4).reshape(size, SLOTS).copy())
            at += 4 + 2 * size * SLOTS
        return out

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(4, "little") + t.astype("<u2").tobytes() for t in self.tables)

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        first = (_spread(hashes) & np.uint64(size - 1)).astype(np.int64)
        return mark.astype(np.uint16), first, CuckooFilter._other(first, mark, size)

    @staticmethod
    def _other(bucket, mark, size: int):
        return (bucket ^ (_spread(np.asarray(mark, np.uint64)) & np.uint64(size - 1)).astype(np.int64))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for table in self.tables:
            mark, a, b = self._places(hashes, len(table))
            found |= ((table[a] == mark[:, None]) | (table[b] == mark[:, None])).any(axis=1)
        return found

    def add(self, hashes: np.ndarray) -> None:
        for k in range(len(hashes)):
            if not self._put(self.tables[-1], hashes[k:k + 1]):
                self.tables.append(np.zeros((2 * len(self.tables[-1]), SLOTS), np.uint16))
                self._put(self.tables[-1], hashes[k:k + 1])

    def _put(self, table: np.ndarray, one: np.ndarray) -> bool:
        mark, a, b = (int(x[0]) for x in self._places(one, len(table)))
        trail, bucket = [], a
        for bucket in (a, b):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        for kick in range(_KICKS):
            slot = kick % SLOTS
            trail.append((bucket, slot, int(table[bucket, slot])))
            mark, table[bucket, slot] = int(table[bucket, slot]), mark
            bucket = int(self._other(bucket, mark, len(table)))
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        for bucket, slot, old in reversed(trail):  # no room: as it was
            table[bucket, slot] = old
        return False

    def remove(self, hashes: np.ndarray) -> None:
        for k in range(len(hashes)):
            for table in reversed(self.tables):
                mark, a, b = (int(x[0]) for x in self._places(hashes[k:k + 1], len(table)))
                hit = next(((x, int(np.flatnonzero(table[x] == mark)[0])) for x in (a, b) if (table[x] == mark).any()), None)
                if hit:
                    table[hit] = 0
                    break
