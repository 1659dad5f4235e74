"""Words and shingles of whole Arrow text columns, as numpy arrays.

A word is a maximal run of bytes other than space and U+0009..U+000D, after lower-casing A-Z.  All
words of a batch are hashed at once from prefix sums of a polynomial in the bytes, so a text costs a few
array operations per byte and no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are taken together up to so many bytes; a longer text is taken alone and whole.
BATCH_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_STEP = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_BYTES[65:91] = _BYTES[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, BATCH_BYTES) + 1, base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if n <= BATCH_BYTES:
            _powers[base] = have
    return have


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, row after the last, bytes, offsets); null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, held = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_BYTES, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[data] * _power(_BASE, n)[:n], out=sums[1:])
    hashed = (sums[stops] - sums[starts]) * _power(_BASE_INVERSE, n)[starts]
    return mix(hashed ^ ((stops - starts).astype(U64) << U64(48))), np.searchsorted(starts, at)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, the ends of texts ignored; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * _WORD_STEP + words[j : j + n]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence of words that is shorter than a shingle."""
    out = U64(len(words) * 0x9FB21C651E98DF25 % (1 << 64))
    for w in words:
        out = mix(np.array([out], U64) * _WORD_STEP + w)[0]
    return np.array([out], U64)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's set of distinct k-word shingles as sorted hashes.

    A text of fewer words has its whole sequence as its only member; a text without words has none.
    """
    words, where = word_hashes(data, at)
    all_shingles = rolling(words, k)
    for i in range(len(at) - 1):
        a, b = where[i], where[i + 1]
        if b - a >= k:
            sorted_ = np.sort(all_shingles[a : b - k + 1])
            fresh = np.ones(len(sorted_), bool)
            np.not_equal(sorted_[1:], sorted_[:-1], out=fresh[1:])
            yield sorted_[fresh]
        elif b > a:
            yield whole(words[a:b])
        else:
            yield words[:0]


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """:func:`shingle_sets` of a whole column, row by row."""
    for _, _, data, at in slices(texts):
        yield from shingle_sets(data, at, k)
