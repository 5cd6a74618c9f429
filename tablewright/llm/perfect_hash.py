"""Minimal perfect hashing of byte strings, in shards, with the keys kept for verification."""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import xxhash

from tablewright.llm.common import WORD_MIX, mixed

SEED = 42  # Spark's xxhash64 of a string uses the same
LEVELS = 24
SPARE = 2.0  # bits for each key of a level


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys, repeat(SEED)), np.uint64, len(keys))


def joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all keys in a row, and their n + 1 limits."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _positions(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h + np.uint64(level + 1) * WORD_MIX) % np.uint64(size)


class PerfectHash:
    """Gives each of n keys a number below n of its own, and any other string none.

    On each level the keys that have a bit of their own are numbered by the bits before it, the others
    go on to the next level; keys that share all 64 bits of their hash end in a small list. A string
    is accepted only if the key stored under its number is equal byte by byte.
    """

    def __init__(self, keys: list[bytes]):
        keys = sorted(keys)  # the same keys always get the same numbers
        h = hashes(keys)
        self.levels, at = [], 0
        slots = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(SPARE * len(left)))
            place = _positions(h[left], level, size).astype(np.int64)
            single = np.bincount(place, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[:size] = single
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            before = at + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]])
            self.levels.append((size, words, before.astype(np.int32)))
            alone = single[place]
            slots[left[alone]] = self._rank(words, before, place[alone])
            at += int(single.sum())
            left = left[~alone]
        self.rest = {keys[i]: at + j for j, i in enumerate(left.tolist())}
        slots[left] = at + np.arange(len(left))
        order = np.empty(len(keys), np.int64)
        order[slots] = np.arange(len(keys))
        data, limits = joined([keys[i] for i in order.tolist()])
        self.data, self.limits = data, limits.astype(np.int32)

    def __len__(self) -> int:
        return len(self.limits) - 1

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        lower = (np.uint64(1) << bit) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & lower)

    def find(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        """Number of each string, -1 for those that are no key."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(left):
                break
            place = _positions(h[left], level, size).astype(np.int64)
            hit = (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            slots[left[hit]] = self._rank(words, before, place[hit])
            left = left[~hit]
        for i in left.tolist() if self.rest else ():
            slots[i] = self.rest.get(keys[i], -1)
        return self._verified(keys, slots)

    def _verified(self, keys: list[bytes], slots: np.ndarray) -> np.ndarray:
        data, limits = joined(keys)
        sizes = np.diff(limits)
        first = self.limits[slots].astype(np.int64)
        same = (slots >= 0) & (self.limits[slots + 1] - first == sizes)
        at = np.flatnonzero(same & (sizes > 0))
        ends = np.cumsum(sizes[at])
        inside = np.arange(int(ends[-1]) if len(at) else 0) - np.repeat(ends - sizes[at], sizes[at])
        equal = self.data[np.repeat(first[at], sizes[at]) + inside] == data[np.repeat(limits[:-1][at], sizes[at]) + inside]
        if len(at):
            same[at] = np.logical_and.reduceat(equal, ends - sizes[at])
        return np.where(same, slots, -1)

    def keys(self, slots: np.ndarray) -> list[bytes]:
        data, limits = self.data.tobytes(), self.limits.tolist()
        return [data[limits[i] : limits[i + 1]] for i in slots.tolist()]

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def unpacked(data: bytes) -> PerfectHash:
    return pickle.loads(data)


class Shards:
    """Perfect hashes of the shards of one set of keys; a key's shard is the top bits of its hash.

    ``bases`` are the numbers of the shards' first keys. Shards that are not here hold no key.
    """

    def __init__(self, bits: int, tables: dict[int, PerfectHash], bases: dict[int, int]):
        self.bits, self.tables, self.bases = bits, tables, bases
        self.order = sorted(tables, key=bases.get)
        self.first = min(bases.values(), default=0)
        self.size = sum(len(t) for t in tables.values())

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of each string, counted from ``first``; -1 for those that are no key here."""
        h = hashes(keys)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        out = np.full(len(keys), -1, np.int64)
        order = np.argsort(shard, kind="stable")
        limits = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for s, table in self.tables.items():
            at = order[limits[s] : limits[s + 1]]
            if len(at):
                found = table.find([keys[i] for i in at.tolist()], h[at])
                out[at] = np.where(found >= 0, found + (self.bases[s] - self.first), -1)
        return out

    def keys(self, slots: np.ndarray) -> list[bytes]:
        """The keys of some numbers (counted from nought over all shards)."""
        out = np.empty(len(slots), object)
        starts = np.array([self.bases[s] for s in self.order], np.int64)
        place = np.searchsorted(starts, slots, side="right") - 1
        for i, s in enumerate(self.order):
            at = np.flatnonzero(place == i)
            if len(at):
                out[at] = self.tables[s].keys(slots[at] - starts[i])
        return out.tolist()
