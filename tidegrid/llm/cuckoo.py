"""A cuckoo filter in numpy whose operations take arrays of keys.

Buckets have four slots of 16-bit fingerprints, 0 being empty. A key is two 64-bit
hashes. Keys that find no place after ``ROUNDS`` rounds go to a further layer
beside the first, so insertion never fails and membership has no false negatives.
Each layer has twice the buckets of the one before, or as many as the keys at hand
need, so a filter that began with a few keys keeps few layers. Bucket numbers are the
low bits of the same numbers in every layer: keys that share mark and buckets in one
layer share them in all smaller ones. Removal looks at the largest layer first, so a
mark taken from another key leaves that key an equal mark in a smaller layer, and
removing a key that was added loses no other.
"""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
LOAD = 0.85
ROUNDS = 200
_HEAD = struct.Struct("<qq")


class CuckooFilter:
    def __init__(self, expected: int = 0):
        self.layers: list[np.ndarray] = []
        self.held: list[int] = []
        if expected:
            self._grow(expected)

    def _grow(self, expected: int) -> None:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, expected) / (SLOTS * LOAD)))))
        buckets = max(buckets, 2 * len(self.layers[-1])) if self.layers else buckets
        self.layers.append(np.zeros((buckets, SLOTS), dtype=np.uint16))
        self.held.append(0)

    @staticmethod
    def _marks(k2: np.ndarray) -> np.ndarray:
        mark = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark)

    @staticmethod
    def _places(layer: np.ndarray, k1: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(layer) - 1)
        first = (k1.view(np.uint64) >> np.uint64(20)) & mask
        return first.astype(np.int64), (first ^ (CuckooFilter._spread(mark) & mask)).astype(np.int64)

    @staticmethod
    def _spread(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(k1), dtype=bool)
        mark = self._marks(k2)
        for layer in self.layers:
            one, two = self._places(layer, k1, mark)
            found |= (layer[one] == mark[:, None]).any(1) | (layer[two] == mark[:, None]).any(1)
        return found

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Keys that are not in yet, each once."""
        while len(k1):
            if not self.layers or self.held[-1] + 1 > self.layers[-1].size * LOAD:
                self._grow(len(k1))
            room = int(self.layers[-1].size * LOAD) - self.held[-1]
            k1, k2 = self._fill(k1[:room], k2[:room], k1[room:], k2[room:])

    def _fill(self, k1, k2, rest1, rest2):
        """Place keys in the last layer; what found no place, with the rest."""
        left = self._place(self.layers[-1], k1, k2)
        self.held[-1] += len(k1) - len(left)
        if len(left):
            self._grow(len(left))
        return np.concatenate([k1[left], rest1]), np.concatenate([k2[left], rest2])

    def _place(self, layer: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Numbers of the keys without a place. A key moved away is undone by putting its mark back."""
        mask = np.uint64(len(layer) - 1)
        mark = self._marks(k2)
        at, _ = self._places(layer, k1, mark)
        owner = np.full(layer.shape, -1, dtype=np.int64)  # which of the new keys holds a slot
        who = np.arange(len(k1))
        before = layer.copy()
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            at, mark, who = at[order], mark[order], who[order]
            fresh = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            free = layer[at] == 0
            slot = ((np.cumsum(free, 1) == (rank + 1)[:, None]) & free).argmax(1)
            fits = rank < free.sum(1)
            layer[at[fits], slot[fits]] = mark[fits]
            owner[at[fits], slot[fits]] = who[fits]
            if fits.all():
                return who[:0]
            first_out = ~fits & (rank == free.sum(1)) & (turn > 0)
            at, mark, who, first_out = at[~fits], mark[~fits], who[~fits], first_out[~fits]
            b, s = at[first_out], (turn + at[first_out]) % SLOTS
            mark[first_out], layer[b, s] = layer[b, s].copy(), mark[first_out].copy()
            who[first_out], owner[b, s] = owner[b, s].copy(), who[first_out].copy()
            at = (at.astype(np.uint64) ^ (self._spread(mark) & mask)).astype(np.int64)
        if (who < 0).any():  # a key of an earlier call has lost its place: start over with none of these keys
            layer[:] = before
            return np.arange(len(k1))
        return who

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Keys that have been added, each once."""
        mark = self._marks(k2)
        for number in reversed(range(len(self.layers))):
            layer = self.layers[number]
            flat = layer.reshape(-1)
            while len(k1):
                one, two = self._places(layer, k1, mark)
                spots = np.concatenate([one[:, None] * SLOTS + np.arange(SLOTS), two[:, None] * SLOTS + np.arange(SLOTS)], 1)
                hit = flat[spots] == mark[:, None]
                has = hit.any(1)
                if not has.any():
                    break
                spot = spots[np.arange(len(k1)), hit.argmax(1)]
                _, chosen = np.unique(np.where(has, spot, -1 - np.arange(len(k1))), return_index=True)
                chosen = chosen[has[chosen]]
                flat[spot[chosen]] = 0
                self.held[number] -= len(chosen)
                keep = np.ones(len(k1), dtype=bool)
                keep[chosen] = False
                k1, k2, mark = k1[keep], k2[keep], mark[keep]

    def to_bytes(self) -> bytes:
        return b"".join(_HEAD.pack(len(x), n) + x.astype("<u2").tobytes() for x, n in zip(self.layers, self.held))

    @classmethod
    def from_bytes(cls, data: bytes | None) -> CuckooFilter:
        out, at = cls(), 0
        while data and at < len(data):
            buckets, held = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            layer = np.frombuffer(data, dtype="<u2", count=buckets * SLOTS, offset=at).astype(np.uint16)
            out.layers.append(layer.reshape(buckets, SLOTS))
            out.held.append(held)
            at += layer.nbytes
        return out
