"""Terms of whole Arrow text columns: runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.

A code point above U+007F is made of bytes above 0x7F in UTF-8, so runs of bytes are runs of code points.
"""

from __future__ import annotations

import zlib

import numpy as np

from cataloom.llm.words import _BASE, _BASE_INVERSE, _BYTES, _power, U64, mix

#: Runs of more bytes are taken one by one, so that a very long term doesn't hold up the others.
LONG = 64
_ONES = 0xFFFFFFFF

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the terms of some texts (``at``: where each begins), and where each text's terms begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = _INSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, A-Z counting as a-z."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * _power(_BASE_INVERSE, len(data))[starts] ^ ((stops - starts).astype(U64) << U64(48)))


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Crc registers after the bytes of runs, one place of all runs at a time."""
    lengths, state = stops - starts, state.copy()
    for i in np.flatnonzero(lengths > LONG):
        state[i] = zlib.crc32(data[starts[i] : stops[i]].tobytes(), int(state[i]) ^ _ONES) ^ _ONES
    short = np.flatnonzero(lengths <= LONG)
    order = short[np.argsort(-lengths[short], kind="stable")]
    own, at, falling = state[order], starts[order], -lengths[order]
    for place in range(int(-falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -place))
        own[:n] = _CRC[(own[:n] ^ data[at[:n] + place]) & np.uint32(255)] ^ (own[:n] >> np.uint32(8))
    state[order] = own
    return state


def crc32s(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned crc32 of every term, of every two terms in a row joined by a space, and where each text's terms begin.

    The second array has one entry a term, which counts only where the next term is of the same text.
    """
    starts, stops, where = runs(data, at)
    lowered = _LOWER[data]
    one = _crc_on(np.full(len(starts), _ONES, np.uint32), lowered, starts, stops)
    two = np.zeros(len(starts), np.uint32)
    if len(starts) > 1:
        gap = _CRC[(one[:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (one[:-1] >> np.uint32(8))
        two[:-1] = _crc_on(gap, lowered, starts[1:], stops[1:])
    return one ^ np.uint32(_ONES), two ^ np.uint32(_ONES), where
