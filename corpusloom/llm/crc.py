"""Words of UTF-8 buffers and CRCs of their runs, whole buffers at a time in numpy.

Bytes are classified by a table, differences of the classes are the word
boundaries, and the registers of all words advance together, a byte a step,
by the table of CRC-32. A long word is cut into chunks whose registers advance
with the others and are then put together, level by level, by tables that
carry a register over 64, 128, 256 ... bytes: a register's way over zero
bytes is linear.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes that a register advances over one by one.
CHUNK = 64
ONES = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """CRC-32's table (reflected polynomial EDB88320)."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> np.uint32(1)) ^ np.where(r & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return r


TABLE = _table()
#: Lower case for A to Z alone; 1 for the bytes of words: digits, letters and all of UTF-8 beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD = np.zeros(256, np.int8)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_lo : _hi + 1] = 1


def _carried(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return tables[0][r & b] ^ tables[1][(r >> np.uint32(8)) & b] ^ tables[2][(r >> np.uint32(16)) & b] ^ tables[3][r >> np.uint32(24)]


@cache
def carry(doublings: int) -> np.ndarray:
    """Four tables, one for each byte of a register, that carry it over 2 ** doublings zero bytes."""
    if doublings == 0:
        r = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return TABLE[r & np.uint32(255)] ^ (r >> np.uint32(8))
    half = carry(doublings - 1)
    return _carried(half, half)


def _step(data: np.ndarray, register: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after `length` bytes from `start`, all at once; the longest go on as long as they need."""
    order = np.argsort(-length, kind="stable")
    r, at, n = register[order], start[order], length[order]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")  # so many are longer than t bytes
    for t, m in enumerate(live):
        s = r[:m]
        r[:m] = TABLE[(s ^ data[at[:m] + t]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(r)
    out[order] = r
    return out


def advance(data: np.ndarray, register: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register after the `length` bytes of data from its `start` on; lengths of any size."""
    chunks = np.maximum(1, -(-length // CHUNK))
    if not len(chunks) or chunks.max() == 1:
        return _step(data, register, start, length)
    first = np.cumsum(chunks) - chunks
    word = np.repeat(np.arange(len(chunks)), chunks)
    head = length - (chunks - 1) * CHUNK  # the first chunk is the odd one
    k = np.arange(len(word)) - first[word]
    r = np.where(k == 0, register[word], np.uint32(0))
    r = _step(data, r, start[word] + np.where(k == 0, 0, head[word] + (k - 1) * CHUNK), np.where(k == 0, head[word], CHUNK))
    doublings = CHUNK.bit_length() - 1
    while chunks.max() > 1:  # pairs from the end: what precedes is carried over the bytes that follow
        fresh = (chunks + 1) // 2
        last, at = np.cumsum(chunks) - 1, np.repeat(np.arange(len(fresh)), fresh)
        j = 2 * (fresh[at] - 1 - (np.arange(len(at)) - (np.cumsum(fresh) - fresh)[at]))  # places from the end
        low, paired = r[last[at] - j], j + 1 < chunks[at]
        low[paired] ^= _carried(carry(doublings), r[(last[at] - j - 1)[paired]])
        r, chunks, doublings = low, fresh, doublings + 1
    return r


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each word: texts lie one after another, text i from bounds[i] to bounds[i + 1]."""
    kind = WORD[data]
    edges = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    inner = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    meet = inner[(kind[inner] == 1) & (kind[inner - 1] == 1)]  # words of two texts that touch
    if len(meet):
        starts, ends = np.sort(np.concatenate([starts, meet])), np.sort(np.concatenate([ends, meet]))
    return starts, ends - starts, np.searchsorted(bounds, starts, side="right") - 1


def run_crcs(data: np.ndarray, bounds: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `most` words, joined by one space: (index of the run's last word, its CRC-32).

    `data` is in lower case; runs stay within their text.
    """
    start, length, text = words(data, bounds)
    register, last, out = np.full(len(start), ONES), np.arange(len(start)), []
    for k in range(1, most + 1):
        if k > 1:
            on = last + 1 < len(start)
            on[on] = text[last[on] + 1] == text[last[on]]
            register, last = register[on], last[on] + 1
            register = TABLE[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
        register = advance(data, register, start[last], length[last])
        out.append((last, register ^ ONES))
    return out
