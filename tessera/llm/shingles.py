"""Five-word shingles as sets of hashes, twice 64 bits each, and their fast similarity sketches, in numpy."""

from __future__ import annotations

import numpy as np

from .common import GOLDEN, lower_ascii, mix64, segment_hashes_128, words_of

WIDTH = 5
T = 128
BANDS, ROWS = 32, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# Odd multipliers, one a position of a shingle.
_PLACE = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets: by each of two independent hashes.

    A text with fewer words than `width` has its whole sequence as one shingle; without words it has none.
    """
    lowered = lower_ascii(raw)
    starts, ends, first = words_of(lowered, offsets)
    counts = np.diff(first)
    return tuple(_sets(words, first, counts, width) for words in segment_hashes_128(lowered, starts, ends))


def _sets(words: np.ndarray, first: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * _PLACE[k] if n >= width else np.zeros(0, np.uint64)
    whole = mix64(sums)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        c, a = int(counts[i]), int(first[i])
        if c >= width:
            s = np.sort(whole[a : a + c - width + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        elif c:
            with np.errstate(over="ignore"):
                s = mix64(np.sum(words[a : a + c] * _PLACE[:c], keepdims=True) + np.uint64(c))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def set_digests(*sets: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A 64-bit sum over each set, of each hash: equal for equal sets, and by chance for one in 2**128 others."""
    out = []
    for hashes, offsets in sets:
        total = np.append(np.uint64(0), np.cumsum(mix64(hashes ^ np.uint64(GOLDEN)), dtype=np.uint64))
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return out


def similar(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> bool:
    """100 * intersection >= 75 * union, by both hashes."""
    for x, y in zip(a, b):
        common = intersection(x, y)
        if 100 * common < 75 * (len(x) + len(y) - common):
            return False
    return True


def sketches(hashes: np.ndarray, offsets: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of each set: t coordinates.

    Round i < t throws every element into a bin drawn by hash and keeps each bin's least hash; bins
    that a round has filled are closed to later ones. Round t + i puts every element into bin i, so
    that after 2t rounds every coordinate of a set that is not empty is filled. Sets leave as soon as
    all of their bins are filled: after about t log(t) elements thrown.
    """
    n = len(offsets) - 1
    out = np.full((n, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    elements = hashes
    active = sizes > 0
    shift = np.uint64(64 - int(t - 1).bit_length())
    for i in range(2 * t):
        if len(elements) == 0:
            break
        h = mix64(elements + np.uint64((i + 1) * GOLDEN % (1 << 64)))
        h[h == _EMPTY] -= np.uint64(1)
        if i < t:
            at = rows * t + (h >> shift).astype(np.int64)
        else:
            at = rows * t + (i - t)
        free = flat[at] == _EMPTY
        np.minimum.at(flat, at[free], h[free])
        still = (out == _EMPTY).any(axis=1) & active
        if not still.all():
            keep = still[rows]
            if not keep.all():
                rows, elements = rows[keep], elements[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of a sketch, distinct between bands."""
    place = mix64(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
    cut = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    return mix64((cut * place).sum(axis=2, dtype=np.uint64) + mix64(np.arange(1, bands + 1, dtype=np.uint64)))


def small_sketch(sketch: np.ndarray) -> np.ndarray:
    return (sketch >> np.uint64(7)).astype(np.uint16)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
