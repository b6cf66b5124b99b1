"""Media columns: finding out what bytes really are.

One Aho-Corasick automaton holds the magic bytes of all formats and finds them at any place in one
pass over a value. A validator for each format then follows the structure from there - chunk
lengths, checksums, trailers - and says where the item ends, so that chance occurrences of two or
three bytes don't count. What starts at the first byte corrects the declared type; what starts
later is embedded and is carved out: its offset, length and type. Base64 data in ``data:`` URIs of
text is decoded and looked at in the same way.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_batches


def _png(b: bytes, at: int) -> int | None:
    end, first = at + 8, True
    while end + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, end)
        kind = b[end + 4 : end + 8]
        stop = end + 12 + n
        if stop > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[end + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return stop
        end, first = stop, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    packed = b[at + 10]
    end = at + 13 + (3 << ((packed & 7) + 1) if packed & 128 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            if b[p] == 0:
                return p + 1
            p += b[p] + 1
        return None

    while end < len(b):
        kind = b[end]
        if kind == 0x3B:
            return end + 1
        if kind == 0x21:
            step = blocks(end + 2)
        elif kind == 0x2C and end + 10 <= len(b):
            flags = b[end + 9]
            step = blocks(end + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return None
        if step is None:
            return None
        end = step
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    end, frame = at + 2, False
    while end + 4 <= len(b):
        if b[end] != 0xFF:
            return None
        kind = b[end + 1]
        if kind == 0xFF:
            end += 1
            continue
        if kind == 0xD9:
            return end + 2 if frame else None
        n = struct.unpack_from(">H", b, end + 2)[0]
        if n < 2 or end + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        end += 2 + n
        if kind == 0xDA:  # coded data: up to the next marker that is neither stuffing nor a restart
            while True:
                end = b.find(b"\xff", end)
                if end < 0 or end + 1 >= len(b):
                    return None
                if b[end + 1] == 0 or 0xD0 <= b[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            if b[end + 1] == 0xD9:
                return end + 2 if frame else None
    return None


def _riff(b: bytes, at: int, form: bytes, chunk: tuple[bytes, ...]) -> int | None:
    if at + 20 > len(b) or b[at + 8 : at + 12] != form:
        return None
    stop = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if stop > len(b) or b[at + 12 : at + 16] not in chunk:
        return None
    end = at + 12
    while end + 8 <= stop:
        n = struct.unpack_from("<I", b, end + 4)[0]
        end += 8 + n + (n & 1)
    return stop if end in (stop, stop + 1) else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header not in (12, 40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    least = start + (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if least <= size <= len(b) - at else None


def _pdf(b: bytes, at: int) -> int | None:
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return None
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop >= 0 else len(b))
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


@lru_cache(2)
def _archives(b: bytes) -> dict[int, int]:
    """Beginning to end of all archives in some bytes, from the records at their ends."""
    found, end = {}, b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - size - offset
        if at >= 0 and end + 22 + note <= len(b) and b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            found[at] = end + 22 + note
        end = b.find(b"PK\x05\x06", end + 4)
    return found


def _zip(b: bytes, at: int) -> int | None:
    return _archives(b).get(at)


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    z, end, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while not z.eof and end < len(b):
            part = view[end : end + 65536]
            end += len(part)
            z.decompress(part, 1 << 20)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return end - len(z.unused_data) if z.eof else None


def _ogg(b: bytes, at: int) -> int | None:
    end, serial, done = at, b[at + 14 : at + 18], None
    while b[end : end + 5] == b"OggS\0" and end + 27 <= len(b):
        n = b[end + 26]
        stop = end + 27 + n + sum(b[end + 27 : end + 27 + n])
        if stop > len(b):
            return None
        last = b[end + 5] & 4 and b[end + 14 : end + 18] == serial
        end = stop
        if last:
            done = end
            break
    return done


def _crc_table(bits: int, poly: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x >> bits - 1 & 1 else x << 1) & (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(b: bytes, at: int) -> int | None:
    """The number of samples of a frame, if a valid frame header stands there."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    if not size or rate == 15 or b[at + 3] & 1:
        return None
    more = next((k for k, mask in ((0, 0x80), (1, 0xE0), (2, 0xF0), (3, 0xF8), (4, 0xFC), (5, 0xFE), (6, 0xFF)) if b[at + 4] & mask == mask << 1 & 0xFF), None)
    if more is None:
        return None
    end = at + 5 + more
    block = end
    end += {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(b):
        return None
    crc = 0
    for c in b[at:end]:
        crc = _CRC8[crc ^ c]
    if crc != b[end]:
        return None
    if size == 1:
        return 192
    if size < 6:
        return 576 << size - 2
    return b[block] + 1 if size == 6 else int.from_bytes(b[block : block + 2], "big") + 1 if size == 7 else 256 << size - 8


def _flac(b: bytes, at: int) -> int | None:
    """A stream ends with the frame that completes its number of samples; where that number isn't
    given, with the last frame that another follows or whose checksum comes out."""
    if at + 42 > len(b) or b[at + 4] & 127 or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    least = max(11, int.from_bytes(b[at + 12 : at + 15], "big"))
    total = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    end = at + 4
    while True:
        if end + 4 > len(b):
            return None
        last, n = b[end] & 128, int.from_bytes(b[end + 1 : end + 4], "big")
        end += 4 + n
        if last:
            break
    samples = _flac_header(b, end)
    if samples is None:
        return None
    start, crc = end, 0
    while end < len(b):
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[end]]
        end += 1
        if crc == 0 and end - start >= least:
            more = _flac_header(b, end)
            if total and samples >= total or not total and more is None:
                return end
            if more is not None:
                start, samples = end, samples + more
    return None


_BOXES = frozenset(b"ftyp moov mdat moof mfra free skip wide pdin styp sidx ssix meta uuid udta prft emsg pnot".split())


def _mp4(b: bytes, at: int) -> int | None:
    end, kinds = at, set()
    while end + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, end)
        if kind not in _BOXES:
            break
        if n == 1 and end + 16 <= len(b):
            (n,) = struct.unpack_from(">Q", b, end + 8)
        n = len(b) - end if n == 0 else n
        if n < 8 or end + n > len(b):
            return None
        kinds.add(kind)
        end += n
    return end if b"ftyp" in kinds and kinds & {b"moov", b"mdat", b"moof", b"meta"} else None


def _mp3_frame(b: bytes, at: int) -> int | None:
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE6 != 0xE2:
        return None
    version, rate, hertz = b[at + 1] >> 3 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or rate in (0, 15) or hertz == 3:
        return None
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if version == 3 else (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
    return (144 if version == 3 else 72) * kbit[rate] * 1000 // ((44100, 48000, 32000)[hertz] >> {3: 0, 2: 1, 0: 2}[version]) + (b[at + 2] >> 1 & 1)


def _mp3(b: bytes, at: int) -> int | None:
    """An ID3 tag and a frame, or four frames in a row at least, and what frames follow."""
    end, tagged = at, b[at : at + 3] == b"ID3"
    if tagged:
        if at + 10 > len(b) or any(c & 128 for c in b[at + 6 : at + 10]):
            return None
        end += 10 + sum(c << 7 * k for k, c in enumerate(reversed(b[at + 6 : at + 10])))
    frames = 0
    while (n := _mp3_frame(b, end)) is not None and end + n <= len(b):
        end += n
        frames += 1
    if frames < (1 if tagged else 4):
        return None
    return end + 128 if b[end : end + 3] == b"TAG" and end + 128 <= len(b) else end


def _tiff(b: bytes, at: int) -> int | None:
    """The directories one after the other; the item ends with the last thing they point to."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    if at + 8 > len(b):
        return None
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    (next_,) = struct.unpack_from(order + "I", b, at + 4)
    stop, seen = 8, set()
    while next_:
        if next_ in seen or at + next_ + 2 > len(b):
            return None
        seen.add(next_)
        (n,) = struct.unpack_from(order + "H", b, at + next_)
        end = next_ + 2 + 12 * n
        if not n or at + end + 4 > len(b):
            return None
        lists: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            entry = at + next_ + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", b, entry)
            if kind not in sizes:
                return None
            where = entry + 8
            if sizes[kind] * count > 4:
                (offset,) = struct.unpack_from(order + "I", b, where)
                stop, where = max(stop, offset + sizes[kind] * count), at + offset
                if where + sizes[kind] * count > len(b):
                    return None
            if kind in (3, 4) and tag in (256, 257, 273, 279, 324, 325):
                lists[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where)
        if 256 not in lists or 257 not in lists:
            return None
        for starts, lengths in ((273, 279), (324, 325)):
            stop = max([stop, *map(sum, zip(lists.get(starts, ()), lists.get(lengths, ())))])
        stop = max(stop, end + 4)
        (next_,) = struct.unpack_from(order + "I", b, at + end)
    return at + stop if seen and at + stop <= len(b) else None


def _matroska(b: bytes, at: int) -> int | None:
    def sized(p: int) -> tuple[int, int] | None:
        """(length, beginning) of what an element holds; -1: of unknown length."""
        if p >= len(b) or not b[p]:
            return None
        n = 9 - b[p].bit_length()
        value = int.from_bytes(b[p : p + n], "big") & (1 << 7 * n) - 1
        return (-1 if value == (1 << 7 * n) - 1 else value), p + n

    head = sized(at + 4)
    if head is None or head[0] < 0 or not re.search(rb"\x42\x82.(?:webm|matroska)", b[head[1] : head[1] + head[0]], re.S):
        return None
    end = head[1] + head[0]
    if b[end : end + 4] != b"\x18\x53\x80\x67" or (body := sized(end + 4)) is None:
        return None
    stop = len(b) if body[0] < 0 else body[1] + body[0]
    return stop if stop <= len(b) else None


#: (magic bytes, how far into the item they are, type, validator: the end of the item or None)
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WEBP", 8, "image/webp", lambda b, at: _riff(b, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X")) if b[at : at + 4] == b"RIFF" else None),
    (b"WAVE", 8, "audio/wav", lambda b, at: _riff(b, at, b"WAVE", (b"fmt ", b"JUNK", b"LIST", b"bext")) if b[at : at + 4] == b"RIFF" else None),
    (b"AVI ", 8, "video/x-msvideo", lambda b, at: _riff(b, at, b"AVI ", (b"LIST",)) if b[at : at + 4] == b"RIFF" else None),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"OggS\0\x02", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"ID3", 0, "audio/mpeg", _mp3),
    (b"\xff\xfb", 0, "audio/mpeg", _mp3),
    (b"\xff\xfa", 0, "audio/mpeg", _mp3),
    (b"\xff\xf3", 0, "audio/mpeg", _mp3),
    (b"\xff\xf2", 0, "audio/mpeg", _mp3),
    (b"II*\0", 0, "image/tiff", _tiff),
    (b"MM\0*", 0, "image/tiff", _tiff),
    (b"\x1aE\xdf\xa3", 0, "video/webm", _matroska),
]
#: in these, items are looked for as well
CONTAINERS = frozenset(["application/pdf", "application/zip"])
_DATA_URI = re.compile(rb"data:([\w.+-]+/[\w.+-]+)?(?:;[\w=.+-]+)*;base64,([A-Za-z0-9+/\s]+={0,2})")
_HTML = re.compile(rb"\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body)\b", re.I | re.S)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by: dict[bytes, list[int]] = {}
    for k, (magic, *_) in enumerate(FORMATS):
        by.setdefault(magic, []).append(k)
    for magic, ks in by.items():
        found.add_word(magic.decode("latin-1"), (len(magic), ks))
    found.make_automaton()
    return found


def items_of(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the items in some bytes, in order. Of an item inside another only
    those in a ``CONTAINERS`` one are told: pictures in a document or in an archive that isn't
    compressed."""
    found, free, container = [], 0, False
    for stop, (n, ks) in _automaton().iter(data.decode("latin-1")):
        for k in ks:
            _, before, kind, check = FORMATS[k]
            at = stop + 1 - n - before
            if at < 0 or at < free and not (container and at > found[-1][0]):
                continue
            end = check(data, at)
            if end is None or end <= at or at < free < end:
                continue
            found.append((at, end - at, kind))
            if end > free or not container:
                container = kind in CONTAINERS
            free = max(free, end)
    return found


def base64_items(data: bytes) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]]]]:
    """(offset of the base64 text, decoded bytes, items in these) of each ``data:`` URI."""
    if b";base64," in data:
        for m in _DATA_URI.finditer(data):
            try:
                inner = base64.b64decode(re.sub(rb"\s", b"", m.group(2)), validate=True)
            except binascii.Error:
                continue
            yield m.start(2), inner, items_of(inner)


def text_type(data: bytes) -> str:
    """The type of bytes that no format fits: HTML, XML, JSON-like or plain text, or unknown."""
    if not data:
        return "application/x-empty"
    if _HTML.match(data):
        return "text/html"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if any(ord(c) < 32 and c not in "\t\n\r\f" for c in text):
        return "application/octet-stream"
    head = text.lstrip()
    return "application/xml" if head.startswith("<?xml") else "image/svg+xml" if head.startswith("<svg") else "text/plain"


def sniff(data: bytes) -> tuple[str, int, list[tuple[int, int, str, str]]]:
    """(type, length of the item at the start, embedded items). Embedded: (offset, length, type,
    how), how being "raw" or "base64"; for the latter, the offset is that of the base64 text and the
    length that of the decoded item, wherever in it that lies."""
    items = items_of(data)
    if items and items[0][0] == 0:
        kind, length = items[0][2], items[0][1]
        inside = [(*x, "raw") for x in items[1:]]
    else:
        kind, length = text_type(data), len(data)
        inside = [(*x, "raw") for x in items]
    for start, _, items in base64_items(data):
        inside += [(start, n, t, "base64") for _, n, t in items]
    return kind, length, sorted(inside)


SCHEMA = "id long, declared string, media_type string, corrected boolean, n_bytes long, item_bytes long, embedded array<struct<offset:long,length:long,media_type:string,encoding:string>>"


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inner = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("encoding", pa.string())]))
    for batch in small_batches(batches, "content"):
        out: list[list] = [[], [], [], [], []]
        for declared, data in zip(batch.column("declared").to_pylist(), batch.column("content").to_pylist()):
            if data is None:
                row = (None, None, None, None, None)
            else:
                kind, length, inside = sniff(data)
                said = (declared or "").split(";")[0].strip().lower()
                row = (kind, said != kind, len(data), length, [dict(zip(("offset", "length", "media_type", "encoding"), x)) for x in inside])
            for column, x in zip(out, row):
                column.append(x)
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), inner)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["id", "declared", "media_type", "corrected", "n_bytes", "item_bytes", "embedded"])


def inspect(rows: DataFrame, id_col: str, content: Column, declared: Column) -> DataFrame:
    """A row for every row: id, declared (as given), media_type (as found), corrected (whether they
    differ), n_bytes, item_bytes (how much of the value the item at its start takes up) and
    embedded. One pass, no shuffle.

    Null content has nulls for all that is found; empty content is application/x-empty. A null
    declaration counts as wrong. Damaged or cut-off items fail their validator: the value is then
    text or application/octet-stream. Repeated rows all come back; an empty table gives an empty
    result; other columns are not looked at and don't come back."""
    bound_batches(rows)
    return rows.select(F.col(id_col).cast("long").alias("id"), declared.alias("declared"), content.cast("binary").alias("content")).mapInArrow(_inspect, SCHEMA)


def carve(rows: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, offset, media_type, encoding, item) for every item of every row, the first one included;
    of base64 items the decoded bytes, at the offset of the base64 text.

    Null and empty content, and what has no item, give no rows. Repeated rows are carved as often
    as they occur; an empty table gives an empty result; other columns are not looked at."""
    bound_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            found = []
            for i, data in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist()):
                if data is not None:
                    found += [(i, at, kind, "raw", data[at : at + n]) for at, n, kind in items_of(data)]
                    found += [(i, start, kind, "base64", inner[at : at + n]) for start, inner, items in base64_items(data) for at, n, kind in items]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["id", "offset", "media_type", "encoding", "item"])

    return rows.select(F.col(id_col).cast("long").alias("id"), content.cast("binary").alias("content")).mapInArrow(run, "id long, offset long, media_type string, encoding string, item binary")
