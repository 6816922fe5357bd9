"""Widths and heights of image files, from their headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import origin

HEAD = 1 << 18  #: bytes of a file that are looked at


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, JPEG, WebP, BMP or ICO header; none for what isn't one."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:4] == b"\0\0\1\0":
            return data[6] or 256, data[7] or 256
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, IndexError):
        pass
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame's header
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 1 if marker == 0xFF else 2 if 0xD0 <= marker <= 0xD9 or marker == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_sizes(spark: SparkSession, folder: str, base_url: str | None = None) -> DataFrame:
    """Rows site, path, width, height of the images in a folder; files that aren't readable as one are left out."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,PNG,gif,GIF,jpg,JPG,jpeg,JPEG,webp,WEBP,bmp,BMP,ico,ICO}").load(root)
    cut = root.split("://")[-1]
    site = F.coalesce(origin(F.lit(base_url).cast("string")), F.lit(""))
    rows = files.select(site.alias("site"), F.substring_index("path", f"{cut}/", -1).alias("path"), F.substring("content", 1, HEAD).alias("head"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = [image_size(x or b"") for x in batch.column("head").to_pylist()]
            yield pa.RecordBatch.from_pydict({"site": batch.column("site"), "path": batch.column("path"), "width": pa.array([x and x[0] for x in sizes], pa.int64()), "height": pa.array([x and x[1] for x in sizes], pa.int64())})

    return rows.mapInArrow(read, "site string, path string, width long, height long").where("width IS NOT NULL")
