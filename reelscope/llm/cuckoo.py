"""A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket; insertion, deletion and lookup of whole arrays at once."""

from __future__ import annotations

import numpy as np

from .words import mixed

SLOTS = 4
KICKS = 500


class Full(Exception):
    """No place was found for a fingerprint; rebuild from the exact table with more buckets."""


def _turns(at: np.ndarray) -> np.ndarray:
    """For each place how many of the same number stand before it."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(at) else np.zeros(0, np.int64)
    out = np.empty(len(at), np.int64)
    out[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return out


class CuckooFilter:
    """No false negatives for what is in it, if only what was inserted is deleted; about SLOTS * 2 / 65536 false positives."""

    def __init__(self, buckets: int):
        self.cells = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for so many keys at a load of at most 0.8."""
        buckets = 2
        while buckets * SLOTS * 0.8 < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def built(cls, hashes: np.ndarray) -> CuckooFilter:
        buckets = len(cls.sized(len(hashes)).cells)
        while True:
            out = cls(buckets)
            try:
                out.insert(hashes)
                return out
            except Full:
                buckets *= 2

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(np.asarray(hashes, np.uint64))
        mask = np.uint64(len(self.cells) - 1)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = h & mask
        return prints, first, (first ^ mixed(prints.astype(np.uint64))) & mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(hashes)
        return ((self.cells[first] == prints[:, None]) | (self.cells[second] == prints[:, None])).any(axis=1)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mixed(prints.astype(np.uint64)).astype(np.int64) & (len(self.cells) - 1))

    def _put(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot in its bucket; says which were put."""
        turn = _turns(at)
        free = self.cells[at] == 0
        put = turn < free.sum(axis=1)
        slots = np.argsort(~free[put], axis=1, kind="stable")[np.arange(int(put.sum())), turn[put]]
        self.cells[at[put], slots] = prints[put]
        return put

    def insert(self, hashes: np.ndarray) -> None:
        """All of hashes or, with Full, none. In each round what found no slot in either bucket turns out one print a bucket, which goes to its other bucket."""
        prints, first, second = self._places(np.atleast_1d(hashes))
        at, before = first.astype(np.int64), self.cells.copy()
        for kick in range(KICKS):
            put = self._put(at, prints)
            at, prints = at[~put], prints[~put]
            over = self._other(at, prints)
            put = self._put(over, prints)
            at, prints = over[~put], prints[~put]
            if not len(at):
                return
            one = _turns(at) == 0
            slots = (prints[one].astype(np.int64) + kick) % SLOTS
            out = self.cells[at[one], slots]
            self.cells[at[one], slots] = prints[one]
            prints[one] = out
            at[one] = self._other(at[one], out)
        self.cells = before
        raise Full

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Deletes one print for each of hashes; says which had one."""
        prints, first, second = self._places(np.atleast_1d(hashes))
        gone = np.zeros(len(prints), bool)
        for places in (first, second):
            left = np.flatnonzero(~gone)
            at, own = places[left].astype(np.int64), prints[left]
            mine = self.cells[at] == own[:, None]
            turn = _turns(at << 16 | own)
            found = turn < mine.sum(axis=1)
            slots = np.argsort(~mine[found], axis=1, kind="stable")[np.arange(int(found.sum())), turn[found]]
            self.cells[at[found], slots] = 0
            gone[left[found]] = True
        return gone

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, body: bytes) -> CuckooFilter:
        out = cls(2)
        out.cells = np.frombuffer(body, np.uint16).reshape(-1, SLOTS).copy()
        return out
