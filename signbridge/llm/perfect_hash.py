"""Minimal perfect hash of a bounded set of 64-bit keys, in numpy.

Level by level, each remaining key marks one bit; keys alone on their bit are placed there, the
others go on to the next level. The place of a key is the rank of its bit among all set bits,
so n keys get the places 0 to n - 1. A fingerprint stored at its place tells a key that is in
the set from one that isn't, but for odds of 2**-32.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that it gets.
SPACE = 2


def scrambled(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, another for each seed."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (scrambled(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> bytes:
    """The levels (length, packed bits) of the distinct ``keys``."""
    out, rest, level = [], keys, 0
    while len(rest):
        size = (SPACE * len(rest) + 7) // 8 * 8
        bit = (scrambled(rest, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(bit, minlength=size) == 1
        out += [np.uint32(size).tobytes(), np.packbits(alone, bitorder="little").tobytes()]
        rest, level = rest[~alone[bit]], level + 1
    return b"".join(out)


def places(levels: bytes, keys: np.ndarray) -> np.ndarray:
    """The place of each key; -1 where no level has its bit (then it isn't in the set)."""
    found = np.full(len(keys), -1, np.int64)
    todo, at, level, before = np.arange(len(keys)), 0, 0, 0
    while at < len(levels) and len(todo):
        size = int(np.frombuffer(levels, np.uint32, 1, at)[0])
        bits = np.unpackbits(np.frombuffer(levels, np.uint8, size // 8, at + 4), bitorder="little").astype(bool)
        bit = (scrambled(keys[todo], level) % np.uint64(size)).astype(np.int64)
        hit = bits[bit]
        ranks = np.cumsum(bits)
        found[todo[hit]] = before + ranks[bit[hit]] - 1
        before += int(ranks[-1])
        todo, at, level = todo[~hit], at + 4 + size // 8, level + 1
    return found
