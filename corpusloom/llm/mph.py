"""A minimal perfect hash over 64-bit keys: levels of bit arrays, built and asked on numpy arrays.

On each level every key left hashes to one bit of an array of GAMMA bits a
key; keys alone on their bit are settled, the others go on to the next level.
A key's slot is the number of set bits before its own. The few keys that no
level settles are kept in a sorted list, so that construction never fails.
`probe` asks stored levels for one key and reads no more than one block of
bits and one count of each level it comes to: two levels on average.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GAMMA, LEVELS = 2.0, 24
#: Bits between two stored counts of the set bits before.
BLOCK = 512


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The finalizer of splitmix64 over keys, offset by the seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray], sizes: list[int], rest: np.ndarray) -> None:
        self.levels, self.sizes, self.rest = levels, sizes, rest
        self.bits = [np.unpackbits(x, bitorder="little")[:n] for x, n in zip(levels, sizes, strict=True)]
        set_before = np.cumsum([0] + [int(b.sum()) for b in self.bits])
        self.ranks = [np.cumsum(b, dtype=np.int64) - b + before for b, before in zip(self.bits, set_before, strict=False)]
        self.settled = int(set_before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct unsigned 64-bit integers."""
        left, levels, sizes = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(GAMMA * len(left)))
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(levels, sizes, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key: 0 to n-1, without repeats, for the keys it was built from; any or -1 for others."""
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            at = (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at] == 1
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            found = self.rest[k] == keys[todo]
            out[todo[found]] = self.settled + k[found]
        return out

    def counts(self) -> list[np.ndarray]:
        """For each level, the set bits (of this and earlier levels) before each block of BLOCK bits."""
        return [np.ascontiguousarray(rank[::BLOCK]).astype("<u8") for rank in self.ranks]


def probe(key: int, sizes: list[int], bits: Callable[[int, int, int], bytes], count: Callable[[int, int], int]) -> int:
    """The slot of one key by stored levels; -1 if no level settles it.

    bits(level, first, n) gives n bytes of a level's bit array from byte
    `first` on; count(level, block) the set bits before a block.
    """
    one = np.array([key], np.int64).view(np.uint64)
    for level, size in enumerate(sizes):
        at = int(mix(one, level)[0] % np.uint64(size))
        block, within = divmod(at, BLOCK)
        held = int.from_bytes(bits(level, block * BLOCK // 8, within // 8 + 1), "little")
        if held >> within & 1:
            return count(level, block) + (held & ((1 << within) - 1)).bit_count()
    return -1
