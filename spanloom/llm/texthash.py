"""Vectorised 64-bit hashing of the words of many texts at once (numpy).

A chunk of documents is one byte array.  Word hashes come from prefix sums of
``T[byte] * P**position`` modulo 2**64, so there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # temporaries of a few times 8 MB stay in the caches

_RNG = np.random.Generator(np.random.PCG64(20240229))
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_MULTS = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
#: A-Z hash as a-z.
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _P), dtype=np.uint64)])
        _inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _PINV), dtype=np.uint64)])
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and int64 offsets of a string column; null becomes empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer document stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each maximal run of non-space bytes.

    ``offsets`` delimit the documents inside ``data``; start and end are
    positions in ``data[offsets[0]:offsets[-1]]``.
    """
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    n = len(part)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    bounds = offsets - base
    inside = ~SPACE[part]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = bounds[1:-1][bounds[1:-1] < n]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = bounds[1:-1]
    before = before[(before > 0) & (before <= n)] - 1
    ends[before] = inside[before]
    first = np.flatnonzero(starts)
    last = np.flatnonzero(ends)
    power, inverse = _powers(n)
    sums = np.cumsum((_FOLDED if fold else _BYTE)[part] * power, dtype=np.uint64)
    total = sums[last] - sums[first] + (_FOLDED if fold else _BYTE)[part[first]] * power[first]
    hashes = mix(total * inverse[first] + (last - first + 1).astype(np.uint64))
    document = np.searchsorted(bounds, first, side="right") - 1
    return hashes, document, first, last + 1


def shingles(hashes: np.ndarray, document: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each document: (hashes ascending per document, offsets).

    A document with fewer words gives its whole sequence as the one shingle.
    """
    counts = np.bincount(document, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    m = len(hashes) - width + 1
    if m > 0:
        grams = hashes[:m] * _MULTS[0]
        for k in range(1, width):
            grams = grams + hashes[k : m + k] * _MULTS[k]
        whole = document[:m] == document[width - 1 :]
        grams, owner = mix(grams[whole]), document[:m][whole]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            words = hashes[first[d] : first[d + 1]]
            extra[i] = np.sum(words * _MULTS[8 : 8 + len(words)], dtype=np.uint64) + np.uint64(len(words))
        grams, owner = np.concatenate([grams, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])
    for d in np.flatnonzero(np.diff(per) > 1):
        grams[per[d] : per[d + 1]].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[keep], owner[keep]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each segment, 0 where it is empty."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, A-Z as a-z."""
    power, inverse = _powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_FOLDED[part] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
