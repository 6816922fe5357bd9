"""Token ids of whole texts with a public byte-level BPE vocabulary, and pieces of bounded length.

Most words recur, so a worker keeps the ids of words that it has met, by 128-bit hashes of the words. A text is cut only where the vocabulary's
own splitting rule always cuts (before a single space, around a single line feed, both between non-space
characters); any other text goes to the library as a whole. The ids equal those of the library on the whole text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_hashes import mixed

END_ID = 0
#: Any white space other than single spaces and single line feeds between other characters (fixed set: Unicode White_Space and U+001C to U+001F).
_WIDE = "\\t\\x0B\\x0C\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_UNEASY = f"[{_WIDE}\\x01]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
_MEMO_MOST, _CHUNK, _RECENT = 1_000_000, 64_000, 100_000
_SLICE_BYTES = 3_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TABLES = np.random.default_rng(20_240_502).integers(0, 2**64, (2, 32, 256), dtype=np.uint64)


def word_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, none of them empty."""
    words = words.cast(pa.large_string())
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1, offset=8 * words.offset)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    starts, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        far = (2 * (place >> 5) + 1).astype(np.uint64)
        return tuple(mixed(np.add.reduceat(t[place & 31, data] * far, starts) + sizes.astype(np.uint64)) for t in _TABLES)


def _sorted(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


class Encoder:
    """Encodes texts; remembers the ids of at most _MEMO_MOST words."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        line = self._plain(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """An empty memo: only the line feed and the empty word, which can't be encoded between line feeds."""
        first, self.check = word_keys(pa.array(["\n", "\x01"], pa.large_string()))
        self.start, self.length = np.array([0, 1], dtype=np.int64), np.array([1, 0], dtype=np.uint32)
        self.flat = np.array([self.line or 0], dtype=np.uint32)
        self.hits = np.full(2, 2**30, dtype=np.int32)
        self.keys = first
        self.levels = [_sorted(first, np.arange(2)), _sorted(first[:0], np.arange(0))]

    def _thin(self) -> None:
        """Forgets the words met once; all of them if that isn't half."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > _MEMO_MOST // 2:
            self._forget()
            return
        sizes = self.length[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.start, self.length, self.hits = ends - sizes, self.length[keep], self.hits[keep] // 2 + 1
        self.keys, self.check = self.keys[keep], self.check[keep]
        self.levels = [_sorted(self.keys, np.arange(len(keep))), _sorted(self.keys[:0], np.arange(0))]

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of words in the memo, -1 for those that it lacks."""
        out = np.full(len(first), -1, dtype=np.int64)
        for keys, places in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                place = places[at]
                hit = (keys[at] == first) & (self.check[place] == second)
                out[hit] = place[hit]
        return out

    def _learn(self, words: list[str], first: np.ndarray, second: np.ndarray) -> None:
        """Words new to the memo; one that begins with U+0001 stands without a space before it."""
        sizes, flats = [], []
        for i in range(0, len(words), _CHUNK):
            some = [w[1:] if w[0] == "\x01" else f" {w}" for w in words[i : i + _CHUNK]]
            ids = np.array(self._plain(["\n".join(some)])[0], dtype=np.uint32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(some) - 1:
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
                flats.append(ids[ids != self.line])
            else:
                each = self._plain(some)
                sizes.append(np.array([len(x) for x in each]))
                flats.append(np.array([y for x in each for y in x], dtype=np.uint32))
        more = np.concatenate(sizes)
        at = len(self.length)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(more) - more])
        self.length = np.concatenate([self.length, more.astype(np.uint32)])
        self.flat = np.concatenate([self.flat, *flats])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), dtype=np.int32)])
        self.keys, self.check = np.concatenate([self.keys, first]), np.concatenate([self.check, second])
        keys, places = self.levels[1]
        keys, places = _sorted(np.concatenate([keys, first]), np.concatenate([places, at + np.arange(len(words))]))
        if len(keys) > _RECENT:
            main, there = self.levels[0]
            self.levels = [_sorted(np.concatenate([main, keys]), np.concatenate([there, places])), (keys[:0], places[:0])]
        else:
            self.levels[1] = keys, places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them); null texts have none."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        uneasy = np.asarray(pc.match_substring_regex(texts, _UNEASY).to_numpy(zero_copy_only=False), dtype=bool)
        if self.line is None:
            uneasy[:] = True
        easy = texts.filter(pa.array(~uneasy))
        flat, counts = self._easy(easy)
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[~uneasy] = counts
        if not uneasy.any():
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        others = self._plain(texts.filter(pa.array(uneasy)).to_pylist())
        lengths[uneasy] = [len(x) for x in others]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(offsets[-1], dtype=np.uint32)
        where = np.repeat(uneasy, lengths)
        out[~where] = flat
        out[where] = [y for x in others for y in x]
        return out, offsets

    def _easy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\x01"), texts, pa.scalar("")), "\n", " \n \x01")
        parts = pc.split_pattern(marked.cast(pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.length) + len(words) > _MEMO_MOST:
            self._thin()
        first, second = word_keys(words)
        places = self._find(first, second)
        if len(new := np.flatnonzero(places < 0)):
            places[new] = len(self.length) + np.arange(len(new))
            self._learn(words.take(pa.array(new)).to_pylist(), first[new], second[new])
        at = places[coded.indices.to_numpy()]
        self.hits += np.bincount(at, minlength=len(self.hits)).astype(np.int32)
        sizes = self.length[at].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[bounds - bounds[0]]
        return flat, np.diff(upto)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker and vocabulary; Spark reuses workers."""
    return Encoder(vocabulary)


def trim() -> None:
    """Gives memory that isn't used any more back to the system, so that workers that Spark keeps stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", encoding: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice hold about _SLICE_BYTES, to bound memory with very long texts.

    Unless the caller is ``encoding``, an encoder that the worker has from an earlier task is let go.
    """
    if not encoding and encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        trim()
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // _SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    trim()


def with_end(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with END_ID after each document."""
    return np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
