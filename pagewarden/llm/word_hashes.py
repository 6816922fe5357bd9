"""64-bit hashes of all words of a batch of texts at once, with NumPy on the batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TABLE = np.random.default_rng(20_240_501).integers(0, 2**64, (32, 256), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in the words, first byte and end byte of each word within its text).

    Words are runs of anything but ASCII white space; A-Z count as a-z. Null texts have no words.
    """
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    ink = ~_SPACES[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    before = np.concatenate([[False], ink[:-1]]) & ~cut[:-1] if len(data) else ink
    starts = np.flatnonzero(ink & ~before)
    after = np.concatenate([ink[1:], [False]]) & ~cut[1:] if len(data) else ink
    ends = np.flatnonzero(ink & ~after) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), starts, ends
    at = np.flatnonzero(ink)
    size = ends - starts
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        term = _TABLE[place & 31, _LOWER[data[at]]] * (2 * (place >> 5) + 1).astype(np.uint64)
        words = mixed(np.add.reduceat(term, np.cumsum(size) - size) + size.astype(np.uint64))
    offsets = np.searchsorted(starts, bounds)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return words, offsets, starts - bounds[text_of], ends - bounds[text_of]


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, text bounds disregarded; n - 1 fewer than words."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mixed(out)


def shingle_sets(words: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; of fewer words, their whole sequence; of none, nothing."""
    every, out = runs(words, n), []
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(runs(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
