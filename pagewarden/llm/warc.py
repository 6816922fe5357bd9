"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, as in the public Zstandard profile of WARC; each
record is a frame of its own, so that one record can be read from its offset with the dictionary alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, kept_by_size, new_folder, stored
from .pfor import put_file

#: The skippable frame's magic number and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100
_ID, _SALTS = "urn:page:", 16
#: Files of the list of archives; on local disks Spark copies its process for each file it makes, so small ones are dear.
_LIST_FILES = 4


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head of the full payload and no body."""
    clean = lambda x: (x or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def trained(samples: list[bytes], most: int) -> bytes:
    """A dictionary's bytes, or none if there are too few samples to train one."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(most, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def classified(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload_bytes, payload_digest, refers_to and refers_url to (page_id, url, html); refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    first = (
        rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first.page_id"))
    return joined.select("page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"))


def write_warc(pages: DataFrame, folder: str, sample: int = 400, sample_bytes: int = 64_000, dictionary_bytes: int = 65_536, file_bytes: int = 8_000_000, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of (page_id, url, html) into ``*.warc.zst`` files.

    Returns one row per file: file, n_records, n_bytes; runs when the result is consumed. Of rows with equal payloads
    of at least LEAST_REVISIT bytes the least page_id (all rows that repeat it) is a response, the others revisit it; a
    null html is an empty payload, a row with a null page_id is always a response. An empty table writes no file. The
    dictionary is trained by the driver on at most ``sample`` responses, chosen by hash, ``sample_bytes`` of each.
    """
    rows = classified(pages)
    chosen = first_by_hash(pages.where("html is not null"), ["page_id", "url"], sample)
    samples = [record_bytes("response", r[0], r[1], r[2].encode()[:sample_bytes], len(r[2].encode()), hashlib.sha256(r[2].encode()).hexdigest(), None, None, date) for r in chosen.select("page_id", "url", F.left("html", F.lit(sample_bytes))).collect()]
    dictionary = trained(samples, dictionary_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        start = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        task, seq, frames, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, frames, size
            put_file(folder, name := f"part-{task:06d}-{seq:06d}.warc.zst", data := start + b"".join(frames))
            out = {"file": [name], "n_records": [len(frames)], "n_bytes": [len(data)]}
            seq, frames, size = seq + 1, [], 0
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for page_id, url, html, length, digest, refers, refers_url in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "refers_url")), strict=True):
                to = refers.as_py()
                payload = b"" if to is not None else html.as_buffer()
                frames.append(compress(record_bytes("response" if to is None else "revisit", page_id.as_py(), url.as_py(), bytes(payload), length.as_py(), digest.as_py(), to, refers_url.as_py(), date)))
                size += len(frames[-1])
                if size >= file_bytes:
                    yield flush()
        if frames:
            yield flush()

    # in order, so that a repeated task writes the same files again
    ordered = rows.sortWithinPartitions("page_id", "payload_digest", "url")
    return ordered.mapInArrow(write, "file string, n_records long, n_bytes long")


def records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    shared, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        shared = zstandard.ZstdCompressionDict(bytes(data[8:at]))
    with io.BufferedReader(zstandard.ZstdDecompressor(dict_data=shared).stream_reader(bytes(data[at:]), read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = stream.read(int(headers["Content-Length"]))
            stream.read(4)
            yield headers, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False, written: DataFrame | None = None) -> DataFrame:
    """One row per record of the archives in a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to, file.

    ``written`` is what write_warc() returned: with it only records of the files that it names are given. Length and digest of a response are computed from the payload read; those of a revisit are in its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("content"), strict=True):
                rows = []
                for headers, block in records(memoryview(data.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response":
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
                            raise ValueError("a payload differs from its digest")
                    at = number(headers["WARC-Record-ID"][1 + len(_ID) : -1])
                    to = number(headers["WARC-Refers-To"][1 + len(_ID) : -1]) if kind == "revisit" else None
                    rows.append((at, headers.get("WARC-Target-URI"), length, digest, kind, to, name.as_py(), payload.decode() if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, payload string"
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    out = files.mapInArrow(read, kind)
    if written is not None:
        out = kept_by_size(out, written.select("file"), "file", "left_semi")
    return out if with_payload else out.drop("payload")


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "payload"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]


def op5_warc(pages: DataFrame) -> DataFrame:
    """Writes the archives of a table of pages and reads them back, one row per page."""
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    written = stored(write_warc(pages.select(F.col("page_id").cast("long"), "url", "html"), folder).repartition(_LIST_FILES), "written")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(spark, folder, written=written).select(*columns)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
