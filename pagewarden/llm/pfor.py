"""Token-id files of patched frame-of-reference blocks.

A file holds whole documents in ascending doc_id order, those without doc_id first: a header (which tells how many have
none), the documents' ids and lengths, the start of every block (so that a reader can jump to any id), then the blocks. A block covers BLOCK ids: its minimum, the bit
width that covers a set percentile of the differences from it, those differences' low bits packed into 64-bit words,
and the positions and high bits of the exceptions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, stored
from .token_ids import crc32, default_vocabulary, encoder, slices, with_end

MAGIC, BLOCK, LANES = b"PFOR0002", 256, 64
HEADER = np.dtype([("magic", "S8"), ("n_docs", "<u8"), ("n_null", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "<u2"), ("n_exceptions", "<u2")])


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of LANES values of so many bits, into rows of ``width`` 64-bit words."""
    out = np.zeros((len(low), width), dtype=np.uint64)
    for lane in range(LANES if width else 0):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= low[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= low[:, lane] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), LANES), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(LANES if width else 0):
        word, shift = divmod(lane * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.9, n_null: int = 0) -> bytes:
    """The bytes of a file with these documents, whose ids stand one after another; ``lengths`` sums to their count.

    The first ``n_null`` documents have no doc_id, whatever number stands there.
    """
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, dtype=np.uint64)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(n_blocks, BLOCK)
    least = rows.min(axis=1) if n_blocks else np.zeros(0, dtype=np.uint64)
    above = rows - least[:, None]
    place = min(BLOCK - 1, int(BLOCK * percentile))
    typical = np.partition(above, place, axis=1)[:, place] if n_blocks else least
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    high = above >> width[:, None].astype(np.uint64)
    where = np.nonzero(high)
    n_exceptions = np.bincount(where[0], minlength=n_blocks)
    packed_bytes = width * (BLOCK // 8)
    sizes = BLOCK_HEAD.itemsize + packed_bytes + n_exceptions * 5
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    head = np.zeros(1, dtype=HEADER)
    head["magic"], head["n_docs"], head["n_null"], head["n_ids"], head["n_blocks"] = MAGIC, len(doc_ids), n_null, len(ids), n_blocks
    body = np.zeros(int(starts[-1]), dtype=np.uint8)
    heads = np.zeros(n_blocks, dtype=BLOCK_HEAD)
    heads["least"], heads["width"], heads["n_exceptions"] = least, width, n_exceptions
    begin = starts[:-1].astype(np.int64)
    body[begin[:, None] + np.arange(BLOCK_HEAD.itemsize)] = heads.view(np.uint8).reshape(n_blocks, BLOCK_HEAD.itemsize)
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        low = (above[some] & np.uint64((1 << int(w)) - 1)).reshape(-1, LANES)
        packed = _pack(low, int(w)).astype("<u8").view(np.uint8).reshape(len(some), -1)
        body[begin[some][:, None] + BLOCK_HEAD.itemsize + np.arange(packed.shape[1])] = packed
    if len(where[0]):  # the exceptions of a block: positions (1 byte each), then high bits (4 bytes each)
        nth = np.arange(len(where[0])) - np.repeat(np.cumsum(n_exceptions) - n_exceptions, n_exceptions)
        at = begin[where[0]] + BLOCK_HEAD.itemsize + packed_bytes[where[0]]
        body[at + nth] = where[1]
        values = high[where].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(at + n_exceptions[where[0]] + 4 * nth)[:, None] + np.arange(4)] = values
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), body.tobytes()])


def _sections(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    head = np.frombuffer(data, HEADER, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token-id file")
    n, at = int(head["n_docs"]), HEADER.itemsize
    doc_ids, lengths = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n)
    starts = np.frombuffer(data, "<u8", int(head["n_blocks"]) + 1, at + 16 * n).astype(np.int64)
    return doc_ids, lengths.astype(np.int64), starts, int(head["n_ids"]), at + 16 * n + 8 * len(starts)


def _blocks(data: bytes, starts: np.ndarray, base: int) -> np.ndarray:
    """The ids of the blocks with these starts; the last entry is the end of the last one."""
    body, begin, n_blocks = np.frombuffer(data, np.uint8), starts[:-1] + base, len(starts) - 1
    heads = body[begin[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).reshape(n_blocks)
    width, n_exceptions = heads["width"].astype(np.int64), heads["n_exceptions"].astype(np.int64)
    out = np.zeros((n_blocks, BLOCK), dtype=np.uint64)
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        packed = body[begin[some][:, None] + BLOCK_HEAD.itemsize + np.arange(int(w) * BLOCK // 8)].copy().view("<u8")
        out[some] = _unpack(packed.reshape(-1, int(w)), int(w)).reshape(len(some), BLOCK)
    if n_exceptions.any():
        block = np.repeat(np.arange(n_blocks), n_exceptions)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exceptions) - n_exceptions, n_exceptions)
        at = begin[block] + BLOCK_HEAD.itemsize + width[block] * (BLOCK // 8)
        value = body[(at + n_exceptions[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        out[block, body[at + nth]] |= value.astype(np.uint64) << width[block].astype(np.uint64)
    return (out + heads["least"][:, None]).astype(np.uint32).ravel()


def n_null(data: bytes) -> int:
    """How many documents of a file, the first ones, have no doc_id."""
    return int(np.frombuffer(data, HEADER, 1)[0]["n_null"])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file."""
    doc_ids, lengths, starts, n_ids, base = _sections(data)
    return doc_ids, lengths, _blocks(data, starts, base)[:n_ids]


def read_range(data: bytes, first: int, count: int) -> np.ndarray:
    """Ids first to first + count of a file; unpacks only the blocks that hold them."""
    _, _, starts, n_ids, base = _sections(data)
    count = max(0, min(count, n_ids - first))
    a, b = first // BLOCK, -(-(first + count) // BLOCK)
    return _blocks(data, starts[a : b + 1], base)[first - a * BLOCK :][:count] if count else np.zeros(0, np.uint32)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: a temporary name first, then a rename; a repeated task overwrites it alike."""
    if urlparse(folder).scheme in ("", "file"):
        local = urlparse(folder).path
        os.makedirs(local, exist_ok=True)
        with open(part := f"{local}/.{name}.{uuid.uuid4().hex}", "wb") as out:
            out.write(data)
        os.replace(part, f"{local}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
            out.write(data)
        store.move(part, f"{path}/{name}")


def write_token_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, percentile: float = 0.9, ids_per_file: int = 1_000_000) -> DataFrame:
    """Encodes the texts of (doc_id, text), appends END_ID to each, writes token-id files in ascending doc_id order.

    Returns one row per file: file, n_docs, n_ids, n_bytes. Runs when the result is consumed. A null text is an
    empty one; rows that share a doc_id stand together, ordered by text; rows without doc_id come first. An empty table
    writes no file. Other columns are not read. Files hold about ``ids_per_file`` ids (one document more at most), so a
    reader needs that much memory. Rows are sorted, so a repeated task writes the same files again.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary).encode, TaskContext.get().partitionId()
        kept: list[tuple[np.ndarray, ...]] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, size, seq
            doc_ids, lengths, ids, valid = (np.concatenate(x) for x in zip(*kept, strict=True))
            name = f"part-{task:06d}-{seq:06d}.pfor"
            put_file(folder, name, data := encode_file(doc_ids, lengths, ids, percentile, int((~valid).sum())))
            kept, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "n_bytes": [len(data)]})

        for batch in batches:
            for part in slices(batch, encoding=True):
                ids, offsets = with_end(*encode(part.column("text")))
                doc_ids, valid = pc.fill_null(part.column("doc_id"), 0).to_numpy(), np.asarray(part.column("doc_id").is_valid())
                a = 0
                while a < len(doc_ids):  # whole documents, up to the file's size
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + ids_per_file - size)))
                    b = min(b, len(doc_ids))
                    kept.append((doc_ids[a:b], np.diff(offsets[a : b + 1]), ids[offsets[a] : offsets[b]], valid[a:b]))
                    size, a = size + int(offsets[b] - offsets[a]), b
                    if size >= ids_per_file:
                        yield flush()
        if kept:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "file string, n_docs long, n_ids long, n_bytes long")


def read_token_ids(spark, folder: str, with_ids: bool = False, written: DataFrame | None = None) -> DataFrame:
    """One row per document of the files in a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file; and its ids.

    ``written`` is what write_token_ids() returned: with it only documents of the files that it names are given, and the
    headers aren't read a second time for the counts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("content"), strict=True):
                doc_ids, lengths, ids = decode_file(data.as_buffer())
                ends = np.cumsum(lengths)
                cut = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                out = {"file": pa.array([name.as_py()] * len(doc_ids), pa.string()), "doc_id": pa.array(doc_ids, mask=np.arange(len(doc_ids)) < n_null(data.as_buffer())), "local": ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array([crc32(x) for x in cut], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = "file string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pydict({"file": [name.as_py()], "n_ids": [_sections(data.as_buffer())[3]]})

    counts = files.mapInArrow(totals, "file string, n_ids long") if written is None else written.select("file", "n_ids")
    # sums within each task's files, then over the tasks, of which there are as many as partitions were written
    counts = counts.withColumn("task", F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = counts.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(before(Window.orderBy("task"))), F.lit(0)).alias("first"))
    seq = F.regexp_extract("file", r"-(\d+)\.pfor$", 1).cast("long")
    starts = counts.withColumn("own", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("task").orderBy(seq))), F.lit(0))).join(tasks, "task").select("file", (F.col("first") + F.col("own")).alias("base"))
    return files.mapInArrow(read, kind).join(starts, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", *["ids"] * with_ids)


def op4_token_ids(docs: DataFrame) -> DataFrame:
    """Writes the token-id files of a table of documents and reads them back, one row per document."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "ids")
    written = stored(write_token_ids(docs, folder), "written")
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_token_ids(spark, folder, written=written)
