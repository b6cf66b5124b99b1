"""A media column made from the pages, as the tables have none: each page's HTML in one of eight
wrappings, with a declared type that is often wrong. The same page always gives the same bytes."""

from __future__ import annotations

import base64
import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

DECLARED = ("text/html", "image/png", "image/jpeg", "application/gzip", "application/zip", "audio/mpeg", "text/plain; charset=utf-8", None)


def png(data: bytes) -> bytes:
    """A grey picture, 64 wide, of the bytes."""
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    rows = [data[k : k + 64].ljust(64, b"\0") for k in range(0, max(1, len(data)), 64)]
    body = zlib.compress(b"".join(b"\0" + r for r in rows), 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def wav(data: bytes) -> bytes:
    data += b"\x80" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def bmp(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // 64))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + rows * 64, 0, 54 + 1024, 40, 64, rows, 1, 8, 0, rows * 64, 0, 0, 256, 0) + bytes(1024) + data.ljust(rows * 64, b"\0")


def archive(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr(zipfile.ZipInfo("page.html"), data)
    return out.getvalue()


def wrapped(number: int, html: bytes) -> bytes:
    way = number % 8
    if way == 1:
        return png(html)
    if way == 2:
        return bmp(html)
    if way == 3:
        return gzip.compress(html, 1, mtime=0)
    if way == 4:
        return archive(html)
    if way == 5:
        return wav(html)
    if way == 6:
        return html + b'<img src="data:image/png;base64,' + base64.b64encode(png(html[:512])) + b'">'
    if way == 7:  # two pictures in something else, then one that is cut off
        return b"\0\1" + html + png(html[:256]) + b"--" + bmp(html[:128]) + png(html)[:-9]
    return html


def column(pages: DataFrame) -> DataFrame:
    """page_id, declared and content for every page; null pages have null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            ids, pages_ = batch.column("page_id").to_pylist(), batch.column("html").to_pylist()
            content = [None if x is None else wrapped(i or 0, x.encode("utf-8", "replace")) for i, x in zip(ids, pages_)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([DECLARED[(i or 0) % 8] for i in ids], pa.string()), pa.array(content, pa.binary())], ["page_id", "declared", "content"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, declared string, content binary")
