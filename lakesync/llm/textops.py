"""Vectorised hashing over the concatenated bytes of a text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lakesync.llm.common import text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# one random 64-bit value per byte, from a fixed rule
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The rolling hash of the ``n`` values from each position on (``len - n + 1`` hashes).

    ``data``: bytes, or 64-bit hashes of larger units.  Built by doubling, so ``n``
    costs its number of binary digits."""
    one = _VALUE[data] if data.dtype == np.uint8 else data
    total = len(one) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out, length, width, doubled = None, 0, 1, one
    while True:
        if n & width:
            out = doubled.copy() if out is None else out[:len(doubled) - length] * _power(width) + doubled[length:length + len(out)]
            length += width
        if length == n:
            return out[:total]
        doubled = doubled[:len(doubled) - width] * _power(width) + doubled[width:]
        width *= 2


def window_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each position on."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(out) - (n - width)], out[n - width:]) if n > width else out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lowered) and the n + 1 bounds of their texts."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(begin) - 1, 0)]
    place[place < 0] = 0
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = np.where(inside, _VALUE[_LOWER[data]] * powers[place], np.uint64(0))
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, bounds)


def shingle_hashes(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``n``-word shingles of each text, sorted within it, and the n + 1 bounds.

    A text with fewer words has its whole word sequence as the only shingle; one
    without words has none."""
    data, bounds = text_bytes(text)
    words, at = word_hashes(data, bounds)
    grams = mix(gram_hashes(words, n) + np.uint64(n))
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    out_count = np.where(count == 0, 0, np.maximum(full, 1))
    ends = np.cumsum(out_count)
    owner = np.repeat(np.arange(len(count)), out_count)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - out_count, out_count)
    values = np.zeros(len(owner), np.uint64)
    enough = full[owner] > 0
    values[enough] = grams[at[owner[enough]] + place[enough]]
    for i in np.flatnonzero((count > 0) & (full == 0)):
        k = int(count[i])
        values[ends[i] - 1] = mix(gram_hashes(words[at[i]:at[i + 1]], k) + np.uint64(k))[0]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


__all__ = ["mix", "gram_hashes", "window_min", "word_hashes", "shingle_hashes"]
