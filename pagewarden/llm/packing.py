"""Pattern packing of documents into token sequences by non-negative least squares.

The driver sees only the histogram of piece lengths (at most ``capacity`` numbers). It enumerates patterns of a few
coarse lengths that fill a sequence, fits repeat counts to the coarse histogram by non-negative least squares, rounds
them down, makes the patterns true with exact lengths (the last one by best fit), and packs what remains, best fit and
longest first, by counts as well. Rows then find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, near_equal_buckets, ranked, stored
from .token_ids import crc32, default_vocabulary, encoder, slices, with_end

CAPACITY = 2048


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares of a x = b with x >= 0, by the active-set method of Lawson and Hanson."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        inside[best] = True
        while True:
            some = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[some] = s
                break
            bad = s <= 1e-12
            step = np.min(x[some][bad] / np.maximum(x[some][bad] - s[bad], 1e-300))
            x[some] += step * (s - x[some])
            x[some[x[some] <= 1e-12]] = 0
            inside &= x > 0
            if not inside.any():
                break
    return x


def patterns(units: int, parts: int) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``parts`` whole numbers that sum to ``units``."""
    found: list[tuple[int, ...]] = []

    def add(left: int, most: int, so_far: tuple[int, ...]) -> None:
        if not left:
            found.append(so_far)
        elif len(so_far) < parts:
            for n in range(min(left, most), 0, -1):
                if n * (parts - len(so_far)) < left:
                    break
                add(left - n, n, (*so_far, n))

    add(units, units, ())
    return found


class _Counts:
    """Pieces left, by length."""

    def __init__(self, left: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in left.items():
            self.n[length] = count

    def fitting(self, space: int, least: int = 1) -> int:
        """The greatest length from ``least`` to ``space`` of which a piece is left, or 0."""
        some = np.flatnonzero(self.n[least : space + 1])
        return least + int(some[-1]) if len(some) else 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = 8, parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences); together they use every piece of the histogram once."""
    left, made = _Counts(histogram, capacity), Counter()
    if left.n[capacity]:
        made[(capacity,)] += int(left.n[capacity])
        left.n[capacity] = 0
    units = capacity // grain
    coarse = np.zeros(units)
    for length in np.flatnonzero(left.n):
        coarse[-(-int(length) // grain) - 1] += left.n[length]
    shapes = patterns(units, parts)
    matrix = np.zeros((units, len(shapes)))
    for i, shape in enumerate(shapes):
        for part in shape:
            matrix[part - 1, i] += 1
    repeats = np.floor(nnls(matrix, coarse)).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i]:
            _realise(shapes[i], int(repeats[i]), left, made, capacity, grain)
    _best_fit(left, made, capacity)
    return sorted(made.items(), reverse=True)


def _realise(shape: tuple[int, ...], repeats: int, left: _Counts, made: Counter, capacity: int, grain: int) -> None:
    """So many sequences of a coarse shape, while it has pieces: exact lengths for all parts, the last by best fit."""
    while repeats > 0:
        chosen, count, space = [], repeats, capacity
        for k, part in enumerate(shape):
            last = k == len(shape) - 1
            length = left.fitting(space if last else min(space, part * grain), 1 if last else (part - 1) * grain + 1)
            if not length:
                break
            chosen.append(length)
            count, space = min(count, int(left.n[length]) // chosen.count(length)), space - length
            if not count:
                chosen.pop()
                break
        # a shape without pieces for all its parts would waste space: what is left of it goes to the last step
        if len(chosen) < len(shape) or not count:
            return
        for length in chosen:
            left.n[length] -= count
        made[tuple(chosen)] += count
        repeats -= count


def _best_fit(left: _Counts, made: Counter, capacity: int) -> None:
    """Longest pieces first, each into the fullest sequence that holds it, by counts; sequences already made are open as well."""
    open_: dict[int, Counter] = {}
    for shape, count in made.items():
        open_.setdefault(capacity - sum(shape), Counter())[shape] += count
    made.clear()
    for length in range(capacity, 0, -1):
        count = int(left.n[length])
        while count:
            space = next((s for s in sorted(open_) if s >= length and open_[s]), None)
            if space is None:
                each = capacity // length
                for size, sequences in ((each, count // each), (count % each, 1)):
                    if size and sequences:
                        open_.setdefault(capacity - size * length, Counter())[(length,) * size] += sequences
                break
            shape, there = next(iter(open_[space].items()))
            used = min(there, count)
            open_[space][shape] -= used
            if not open_[space][shape]:
                del open_[space][shape]
            if not open_[space]:
                del open_[space]
            open_.setdefault(space - length, Counter())[(*shape, length)] += used
            count -= used
        left.n[length] = 0
    for shapes in open_.values():
        made.update(shapes)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """Token pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids and _order (the column ``order``).

    Each document's ids end with END_ID, so an empty or null text is one piece of one id. Only longer documents are
    cut, into pieces of ``capacity``; the first may be shorter.
    """
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, encoding=True):
                ids, offsets = with_end(*encode(part.column("text")))
                total = np.diff(offsets)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                begin = offsets[row] + start
                out = {"doc_id": part.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length}
                out["ids_crc32"] = pa.array([crc32(ids[a : a + m]) for a, m in zip(begin, length, strict=True)], pa.int64())
                if order:
                    out["_order"] = part.column("_order").take(pa.array(row))
                if with_ids:
                    out["ids"] = pa.array([ids[a : a + m].astype(np.int32) for a, m in zip(begin, length, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", _order long" * bool(order) + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text", *([F.col(order).cast("long").alias("_order")] if order else [])).mapInArrow(lean(cut), kind)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, grain: int = 8, parts: int = 3, order: str | None = None) -> DataFrame:
    """Packs the documents' token pieces into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. Every piece
    gets a place; sequences are gapless from offset 0. ``order`` names a column of 64-bit numbers, spread about evenly
    over their range: of pieces of one length those come first in whose documents it is less, and sequences of all
    patterns are numbered in step, so that ascending sequence_ids follow the documents' order as far as lengths allow.
    Without it the order is that of a hash. An empty table gives an empty result; repeated rows, ties and null doc_ids
    are packed like others; texts may have any length; columns other than doc_id, text and ``order`` are not read.
    """
    rows = stored(pieces_of(docs, capacity, vocabulary, with_ids, order), "pieces")
    shown = [c for c in rows.columns if c != "_order"]
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    # for each shape and length in it: its first rank, how many pieces of the length a sequence has, and their offsets
    key, each, at, offset, number, begin, step = [], [], [], [], [], [], []
    ranks: Counter = Counter()
    for n, (shape, count) in enumerate(plan(histogram, capacity, grain, parts)):
        starts = np.concatenate([[0], np.cumsum(shape)[:-1]])
        far = sum((ranks[x] + shape.count(x) / 2) / histogram[x] for x in shape) / len(shape)
        for length in sorted(set(shape)):
            own = [int(a) for a, x in zip(starts, shape, strict=True) if x == length]
            key.append((length << 44) + ranks[length])
            each.append(len(own))
            at.append(len(offset))
            offset += own
            number.append(n)
            # where in the order the pieces of the shape's sequences are on average: of the first one, and from one to the next
            begin.append(far)
            step.append(sum(shape.count(x) / histogram[x] for x in shape) / len(shape))
            ranks[length] += count * len(own)
    by_key = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    keys, several, firsts, shapes = (np.array(x, dtype=np.int64)[by_key] for x in (key, each, at, number))
    begins, steps = (np.array(x, dtype=np.float64)[by_key] for x in (begin, step))
    offsets = np.array(offset, dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            where = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            nth, slot = np.divmod(rank - (keys[where] & ((1 << 44) - 1)), several[where])
            # how far a sequence is in the order, then its shape
            sequence = ((begins[where] + nth * steps[where]) * 2.0**40).astype(np.int64) << 22 | shapes[where]
            out = {c: batch.column(c) for c in shown}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": sequence, "offset": offsets[firsts[where] + slot]})

    spread = rows if order else rows.withColumn("_order", F.xxhash64("doc_id", "piece"))
    placed = ranked(spread.withColumn("_order", F.coalesce("_order", F.lit(0).cast("long"))), ["length"], "_order", ["doc_id", "piece", "ids_crc32"], near_equal_buckets(sum(histogram.values())))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_order") + ", sequence_id long, offset long"
    return placed.select(*shown, "rank").mapInArrow(lean(assign), kind)
