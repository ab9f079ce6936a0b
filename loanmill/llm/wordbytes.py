"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a loop over words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Text is hashed in slices of about so many bytes; a longer document is a slice of its own.
_SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
     0x589965CC75374CC3],
    dtype=np.uint64,
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@functools.cache
def _powers(base: int, bits: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, 2^bits of them."""
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, UTF-8 bytes, offsets) of consecutive texts; null counts as empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + _SLICE, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and the index of its text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    apart = np.zeros(len(data) + 1, bool)
    apart[offsets] = True
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & (apart[:-1] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (apart[1:] | np.r_[~word[1:], True])) + 1
    bits = max(20, int(len(data)).bit_length())
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(
        (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(data)],
        out=sums[1:],
    )
    back = _powers(pow(_BASE, -1, 1 << 64), bits)
    hashes = mixed((sums[ends] - sums[starts]) * back[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, seed: int = 0) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles.

    A text of fewer words has one, of all its words; one without words has none.
    """
    width, salt = len(_FACTORS), np.uint64(seed * 2 + 1)
    for _, data, offsets in slices(texts):
        w, doc = words(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(doc, np.arange(n + 1))
        full = np.zeros(max(0, len(w) - width + 1), np.uint64)
        for j in range(width):
            full += w[j : j + len(full)] * _FACTORS[j]
        full = mixed(full * salt)
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                few = (w[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mixed((few + np.uint64(b - a)) * salt)
            else:
                yield np.zeros(0, np.uint64)
