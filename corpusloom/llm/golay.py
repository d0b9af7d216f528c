"""The perfect binary [23,12,7] Golay code: decoding and nearby codewords, on numpy arrays."""

from __future__ import annotations

import itertools

import numpy as np

#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
LENGTH, DATA = 23, 12
CHECKS = LENGTH - DATA


def _remainders() -> np.ndarray:
    """Check bits of each of the 4096 messages."""
    out = np.zeros(1 << DATA, np.int32)
    for m in range(1 << DATA):
        r = m << CHECKS
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - CHECKS)
        out[m] = r
    return out


REMAINDER = _remainders()


def syndrome(v: np.ndarray) -> np.ndarray:
    return REMAINDER[v >> CHECKS] ^ (v & ((1 << CHECKS) - 1))


def _leaders() -> np.ndarray:
    """The one error of weight three or less for each of the 2048 syndromes."""
    out = np.zeros(1 << CHECKS, np.int32)
    for weight in range(4):
        for bits in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            out[syndrome(np.array([e]))[0]] = e
    return out


LEADER = _leaders()


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12 data bits of the nearest codeword."""
    return (v ^ LEADER[syndrome(v)]) >> CHECKS


def nearby_indices(v: np.ndarray) -> np.ndarray:
    """For each value the indices of the codewords that it or one flipped bit decodes to.

    One row of 24 a value, sorted, repeats included. The codeword nearest to a
    value is always among those of any value one bit away, so values that
    differ in at most one bit share an index.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int32)
    return np.sort(codeword_index(np.asarray(v, np.int32)[:, None] ^ flips[None, :]), axis=1)
