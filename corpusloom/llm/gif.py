"""GIF streams in plain Python and numpy: a writer of 8-bit frames and a reader of any GIF.

The reader decodes the LZW code streams, applies global and local palettes,
interlace, disposal and transparency, and gives timed frames, both as the
stored samples and as the composed canvas. What a file declares is checked
against limits before anything of that size is made.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAX_BITS = 12
#: Pixels of a screen or frame, and of all frames together, at most.
PIXELS, ALL_PIXELS = 1 << 24, 1 << 28
#: First row and step of the four passes of interlaced images.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def _widths(clear: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    nxt = clear + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(MAX_BITS, np.frexp(nxt.astype(float))[1]).astype(np.int64)


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The code stream of the samples, from a first clear code to the end code."""
    clear, limit = 1 << size, (1 << MAX_BITS) - 1
    codes, widths, run = [clear], [np.array([size + 1])], []

    def flush(end: int) -> None:
        run.append(end)
        widths.append(_widths(clear, len(run)))
        codes.extend(run)
        run.clear()

    table: dict[int, int] = {}
    get, nxt, put = table.get, clear + 2, run.append
    if samples:
        p = samples[0]
        for b in samples[1:]:
            k = p << 8 | b
            c = get(k)
            if c is not None:
                p = c
                continue
            put(p)
            table[k] = nxt
            p = b
            if nxt == limit:
                flush(clear)
                table.clear()
                nxt = clear + 1
            nxt += 1
        put(p)
    flush(clear + 1)
    code, width = np.array(codes, np.int64), np.concatenate(widths)
    at = np.cumsum(width) - width
    bits = np.zeros(int(at[-1] + width[-1]), np.uint8)
    for b in range(MAX_BITS):
        wide = width > b
        bits[at[wide] + b] = code[wide] >> b & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, expected: int) -> bytes:
    """The samples of a code stream, `expected` at most."""
    clear, end = 1 << size, (1 << size) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at = 8 * len(stream), 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = 0
    cycle = _widths(clear, (1 << MAX_BITS) - clear)
    while at < total and made < expected:
        table, prev, extra = list(roots), None, 0
        put, full = table.append, 1 << MAX_BITS
        while True:  # all codes up to a clear or end code; widths follow from the codes' number alone
            width = cycle if not extra else np.full(4096, MAX_BITS, np.int64)
            pos = at + np.cumsum(width) - width
            fit = pos + width <= total
            pos, width = pos[fit], width[fit]
            byte = pos >> 3
            got = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (pos & 7)) & ((1 << width) - 1)
            stop = np.nonzero((got == clear) | (got == end))[0]
            n = int(stop[0]) if len(stop) else len(got)
            for c in got[:n].tolist():
                if prev is None:
                    entry = table[c]
                else:
                    entry = table[c] if c < len(table) else prev + prev[:1]
                    if len(table) < full:
                        put(prev + entry[:1])
                out.append(entry)
                made += len(entry)
                prev = entry
            if len(stop):
                at = int(pos[n] + width[n])
                if got[n] == end:
                    return b"".join(out)[:expected]
                break
            if not len(got):
                return b"".join(out)[:expected]
            at, extra = int(pos[-1] + width[-1]), extra + 1
    return b"".join(out)[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(payload: bytes, width: int = 64, rows: int = 1024, delay: int = 10) -> bytes:
    """A GIF whose frames hold the payload as samples under a grey palette.

    The payload's length is a positive multiple of the width. Each frame has
    `rows` rows at most and is shown for `delay` hundredths of a second.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    step = width * rows
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a" + struct.pack("<HHBBB", width, min(rows, len(payload) // width), 0xF7, 0, 0) + grey]
    for lo in range(0, len(payload), step):
        frame = payload[lo : lo + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08" + _blocks(lzw_encode(frame)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: bytes
    canvas: np.ndarray  # height x width x 4, as shown


def read_gif(data: bytes, pixels: int = PIXELS, all_pixels: int | None = ALL_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF in order; stops at the trailer or where the data ends.

    A ValueError for data that are no GIF, and for one that declares a screen
    or frame of more pixels than `pixels`, or frames of more than `all_pixels` (None: no limit).
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if wide * high > pixels:
        raise ValueError("a screen beyond the limit")
    at, palette, painted = 13, None, 0

    def colours(flag: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flag & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def joined() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        palette = colours(flags)
    canvas = np.zeros((high, wide, 4), np.uint8)
    clock, control = 0, (0, 0, None)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = joined()
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, hundredths, index if packed & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            table = colours(packed) if packed & 0x80 else palette
            size = data[at]
            at += 1
            painted += max(w * h, wide * high)
            if w * h > pixels or (all_pixels is not None and painted > all_pixels) or not 1 <= size <= 8:
                raise ValueError("a frame beyond the limits")
            samples = lzw_decode(joined(), size, w * h).ljust(w * h, b"\0")
            if packed & 0x40:
                rows = np.frombuffer(samples, np.uint8).reshape(h, w)
                order = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
                plain = np.empty_like(rows)
                plain[order] = rows
                samples = plain.tobytes()
            disposal, hundredths, transparent = control
            before = canvas.copy() if disposal == 3 else None
            index = np.frombuffer(samples, np.uint8).reshape(h, w)
            lut = np.zeros((256, 4), np.uint8)
            if table is not None:
                lut[: len(table), :3], lut[: len(table), 3] = table, 255
            view = canvas[top : top + h, left : left + w]
            shown = lut[index][: view.shape[0], : view.shape[1]]
            if transparent is None:
                view[:] = shown
            else:
                seen = (index != transparent)[: view.shape[0], : view.shape[1]]
                view[seen] = shown[seen]
            yield Frame(clock, 10 * hundredths, left, top, w, h, disposal, transparent, samples, canvas.copy())
            clock += 10 * hundredths
            if disposal == 2:
                view[:] = 0
            elif disposal == 3:
                canvas = before
            control = (0, 0, None)
        elif kind == 0x3B:
            return
