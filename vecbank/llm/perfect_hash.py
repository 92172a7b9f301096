"""Minimal perfect hashing of whole numbers by hash and displace, in segments of bounded size.

A key's hash names its segment and a bucket there. Buckets of several keys, the largest first, are given the first seed
that sends all their keys to free slots; a bucket of one key stores its slot itself. A segment of m keys has m slots, each
holding its key, so that other keys are told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Keys fall into this many bins; segments are runs of bins, so their number can be chosen when the keys are known.
BINS = 4096
PER_BUCKET = 4
SEEDS_AT_ONCE = 64


def mixed(keys: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """64 well-mixed bits of each key under a seed."""
    x = keys.astype(np.uint64) + np.atleast_1d(np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def bins(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) % np.uint64(BINS)).astype(np.int32)


def buckets(keys: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(20)) % np.asarray(number).astype(np.uint64)).astype(np.int64)


def bucket_number(m: int) -> int:
    return -(-m // PER_BUCKET)


def displaced(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, keys in the order of their slots) for distinct keys."""
    m = len(keys)
    bucket = buckets(keys, bucket_number(m))
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=bucket_number(m))
    starts = np.cumsum(sizes) - sizes
    seeds, slots, free = np.zeros(len(sizes), np.int32), np.empty(m, np.int64), np.ones(m, bool)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[starts[b] : starts[b] + sizes[b]]
        if len(own) <= 1:
            break
        seed = 1
        while True:
            tried = np.arange(seed, seed + SEEDS_AT_ONCE)
            to = np.sort((mixed(keys[own][None, :], tried[:, None]) % np.uint64(m)).astype(np.int64), axis=1)
            fits = free[to].all(axis=1) & (to[:, 1:] != to[:, :-1]).all(axis=1)
            if fits.any():
                seed += int(fits.argmax())
                break
            seed += SEEDS_AT_ONCE
        seeds[b] = seed
        slots[own] = (mixed(keys[own], seed) % np.uint64(m)).astype(np.int64)
        free[slots[own]] = False
    single = np.flatnonzero(sizes == 1)
    places = np.flatnonzero(free)
    slots[order[starts[single]]] = places
    seeds[single] = -places - 1
    at_slot = np.empty(m, keys.dtype)
    at_slot[slots] = keys
    return seeds, at_slot


def slots_of(keys: np.ndarray, seeds: np.ndarray, m: int | np.ndarray, first_bucket: int | np.ndarray = 0) -> np.ndarray:
    """The slot within its segment that each key would have; only the key stored there tells whether it is one."""
    m = np.asarray(m)
    seed = seeds[first_bucket + buckets(keys, -(-m // PER_BUCKET))]
    return np.where(seed < 0, -seed.astype(np.int64) - 1, (mixed(keys, np.maximum(seed, 0)) % m.astype(np.uint64)).astype(np.int64))


@dataclass
class Counts:
    """Segments of a hash with a dense vector of counts, laid end to end."""

    segment_of_bin: np.ndarray
    sizes: np.ndarray
    first_slot: np.ndarray
    first_bucket: np.ndarray
    seeds: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, segment_of_bin: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Counts:
        """From (segment, seeds, keys, counts) of the segments that are at hand; keys of others are not found."""
        sizes = np.zeros(int(segment_of_bin.max()) + 1, np.int64)
        first_slot, first_bucket = np.zeros_like(sizes), np.zeros_like(sizes)
        slot = bucket = 0
        for segment, seeds, keys, _ in parts:
            sizes[segment], first_slot[segment], first_bucket[segment] = len(keys), slot, bucket
            slot, bucket = slot + len(keys), bucket + len(seeds)
        joined = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
        keys, counts = joined(2), joined(3)
        if len(keys) and keys.max() < 1 << 32:
            keys = keys.astype(np.uint32)
        return cls(segment_of_bin, sizes, first_slot, first_bucket, joined(1).astype(np.int32), keys, counts)

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, zero for keys that the segments at hand do not hold."""
        found = np.zeros(len(keys), np.int64)
        segment = self.segment_of_bin[bins(keys)]
        held = np.flatnonzero(self.sizes[segment])
        if len(held):
            own, segment = keys[held], segment[held]
            slot = self.first_slot[segment] + slots_of(own, self.seeds, self.sizes[segment], self.first_bucket[segment])
            same = self.keys[slot] == own
            found[held[same]] = self.counts[slot[same]]
        return found
