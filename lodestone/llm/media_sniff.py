"""Signature sniffing: magic bytes by Aho-Corasick, confirmed by format validators; media carved out of other media.

``store`` keeps bytes losslessly as 8-bit samples: a text's hash picks a mono WAVE stream, the grey pixels of a PNG or of a BMP, or a ZIP archive
that holds the WAVE stream as its one stored member. ``sniff`` trusts no declared type: one Aho-Corasick pass finds the
magic bytes of all formats, the format's validator walks its structure and returns its length or refuses, the type at offset 0 corrects the declared
one, and every confirmed object inside another is carved. The samples are read from the object itself or, if it is a ZIP, from the object carved first.

A ZIP is read by its central directory, so an archive stored in it doesn't end it; a PDF by startxref and the ``%%EOF`` after it, with its incremental
updates; FLAC frame by frame, each with the CRC-8 of its header and the CRC-16 of its whole.

Defined results: null text or media counts as empty bytes; media of no known format has the type
application/octet-stream and nothing carved; of overlapping carved objects the outermost first one stays, and objects inside
it are listed too. Extra columns pass through; a taken output name is an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The payload is filled up to a multiple of this with bytes 255.
UNIT, FILL = 576, b"\xff"
UNKNOWN = "application/octet-stream"
RATE = 8_000


def wave(payload: bytes) -> bytes:
    """A RIFF WAVE stream with one unsigned 8-bit sample per byte."""
    pad = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


#: Pixels in a row of an image: the unit, so that every row is full.
WIDTH = UNIT
FORMS = ("wave", "png", "bmp", "zip")


def png(payload: bytes) -> bytes:
    """A grey 8-bit PNG, WIDTH pixels a row; the payload's length is a multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # each row after its filter type, none
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def bmp(payload: bytes) -> bytes:
    """An 8-bit BMP with a grey palette, rows from the top; WIDTH needs no padding."""
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    offset = 14 + 40 + len(palette)
    head = struct.pack("<IiiHHIIiiII", 40, WIDTH, -(len(payload) // WIDTH), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return struct.pack("<2sIHHI", b"BM", offset + len(payload), 0, 0, offset) + head + palette + payload


def zipped(payload: bytes) -> bytes:
    """A ZIP archive of one stored member, a WAVE stream."""
    body, name = wave(payload), b"samples.wav"
    crc, size, date = zlib.crc32(body), len(body), 33  # 1980-01-01
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 0, 0, date, crc, size, size, len(name), 0) + name
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 0, 0, 0, date, crc, size, size, len(name), 0, 0, 0, 0, 0, 0) + name
    return local + body + central + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(central), len(local) + size, 0)


_MADE = {"wave": wave, "png": png, "bmp": bmp, "zip": zipped}


def _riff(d: memoryview, at: int, form: bytes) -> int | None:
    if at + 12 > len(d) or bytes(d[at + 8 : at + 12]) != form:
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d) or end < at + 20:
        return None
    k, seen = at + 12, set()
    while k + 8 <= end:
        name, size = struct.unpack_from("<4sI", d, k)
        if k + 8 + size > end:
            return None
        seen.add(name)
        k += 8 + size + (size & 1)
    return end - at if form != b"WAVE" or {b"fmt ", b"data"} <= seen else None


def _png(d: memoryview, at: int) -> int | None:
    k = at + 8
    while k + 12 <= len(d):
        size, name = struct.unpack_from(">I4s", d, k)
        if k + 12 + size > len(d) or zlib.crc32(d[k + 4 : k + 8 + size]) != struct.unpack_from(">I", d, k + 8 + size)[0]:
            return None
        k += 12 + size
        if name == b"IEND":
            return k - at
    return None


def _gif(d: memoryview, at: int) -> int | None:
    def blocks(k: int) -> int | None:
        while k < len(d) and d[k]:
            k += 1 + d[k]
        return k + 1 if k < len(d) else None

    if at + 13 > len(d):
        return None
    k = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 128 else 0)
    while k is not None and k < len(d):
        if d[k] == 0x3B:
            return k + 1 - at
        if d[k] == 0x21:
            k = blocks(k + 2)
        elif d[k] == 0x2C and k + 10 < len(d):
            k = blocks(k + 11 + (3 << ((d[k + 9] & 7) + 1) if d[k + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(d: memoryview, at: int) -> int | None:
    k, scanned = at + 2, False
    while k + 4 <= len(d):
        if d[k] != 0xFF:
            return None
        mark = d[k + 1]
        size = struct.unpack_from(">H", d, k + 2)[0]
        if mark == 0xD9:
            return k + 2 - at if scanned else None
        if size < 2:
            return None
        k += 2 + size
        if mark == 0xDA:
            scanned, raw = True, bytes(d[k:])
            j = 0
            while (j := raw.find(b"\xff", j)) >= 0 and j + 1 < len(raw) and (raw[j + 1] == 0 or 0xD0 <= raw[j + 1] <= 0xD7):
                j += 2
            if j < 0 or j + 1 >= len(raw):
                return None
            k += j
            if raw[j + 1] == 0xD9:
                return k + 2 - at
    return None


def _bmp(d: memoryview, at: int) -> int | None:
    if at + 30 > len(d):
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    good = head in (40, 108, 124) and zero == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= offset <= size
    return size if good and at + size <= len(d) else None


@lru_cache(maxsize=2)
def _zip_ends(data: bytes) -> dict[int, list[int]]:
    """End records of ZIP archives, by the place where the archive begins if the record is right."""
    out: dict[int, list[int]] = {}
    k = -1
    while (k := data.find(b"PK\x05\x06", k + 1)) >= 0 and k + 22 <= len(data):
        size, offset = struct.unpack_from("<II", data, k + 12)
        out.setdefault(k - offset - size, []).append(k)
    return out


def _zip(d: memoryview, at: int) -> int | None:
    """The first end record that fits an archive beginning here: its central directory lies right before it, and each entry points at a local header."""
    data = d.obj
    for k in _zip_ends(data).get(at, ()):
        entries, size, offset, note = struct.unpack_from("<HIIH", data, k + 10)
        j, left = at + offset, entries
        while left and j + 46 <= k and data[j : j + 4] == b"PK\x01\x02":
            name, extra, remark = struct.unpack_from("<HHH", data, j + 28)
            where = at + struct.unpack_from("<I", data, j + 42)[0]
            if data[where : where + 4] != b"PK\x03\x04":
                break
            j, left = j + 46 + name + extra + remark, left - 1
        if not left and j == k and k + 22 + note <= len(data):
            return k + 22 + note - at
    return None


@lru_cache(maxsize=2)
def _pdf_ends(data: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each %%EOF with a startxref begins, and its end and the offset it names. 0 is the one in front of a linearised file."""
    found = [(m.start(), m.end(), int(m[1])) for m in re.finditer(rb"startxref\s+(\d{1,10})\s+%%EOF", data)]
    found = [x for x in found if x[2]]
    return [x[0] for x in found], [x[1:] for x in found]


def _pdf(d: memoryview, at: int) -> int | None:
    """Up to the first %%EOF whose startxref points at a cross-reference table or stream of the file beginning here, and on through updates whose tables lie behind the end before."""
    starts, found = _pdf_ends(d.obj)
    end = None
    for i in range(bisect_left(starts, at), len(starts)):
        where = at + found[i][1]
        if (end or at) < where < starts[i] and re.match(rb"xref\b|\d+\s+\d+\s+obj\b", d.obj[where : where + 24]):
            end = found[i][0]
        elif end:
            break
    return end - at if end else None


def _gzip(d: memoryview, at: int) -> int | None:
    z = zlib.decompressobj(31)
    try:
        k = at
        while not z.eof and k < len(d):
            z.decompress(bytes(d[k : k + 65536]))
            k += 65536
    except zlib.error:
        return None
    return min(k, len(d)) - len(z.unused_data) - at if z.eof else None


def _crc_table(bits: int, poly: int) -> list[int]:
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for v in range(256):
        c = v << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        table.append(c)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(d: memoryview, k: int) -> tuple[int, int] | None:
    """Length of a frame header with its CRC-8, and the samples of the frame, if one begins here."""
    if k + 6 > len(d) or d[k] != 0xFF or d[k + 1] >> 2 != 0x3E or d[k + 1] & 2 or d[k + 2] >> 4 == 0 or d[k + 2] & 15 == 15 or d[k + 3] & 1:
        return None
    lead, n, code = d[k + 4], 1, d[k + 2] >> 4
    if lead & 0x80:
        n = 8 - (lead ^ 0xFF).bit_length()
        if not 2 <= n <= 7:
            return None
    more = {6: 1, 7: 2}.get(code, 0)
    end = k + 4 + n + more + {12: 1, 13: 2, 14: 2}.get(d[k + 2] & 15, 0)
    if end >= len(d):
        return None
    c = 0
    for v in d[k:end]:
        c = _CRC8[c ^ v]
    # Block sizes by their code.
    block = int.from_bytes(d[k + 4 + n : k + 4 + n + more], "big") + 1 if more else 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    return (end + 1 - k, block) if c == d[end] else None


def _flac(d: memoryview, at: int) -> int | None:
    """Metadata blocks, then frames. A frame ends where the CRC-16 since its beginning comes to nothing and another header follows; the last, by the count of samples or the lack of a header, where it first does."""
    k, first, total = at + 4, True, 0
    while True:
        if k + 4 > len(d):
            return None
        last, kind, size = d[k] >> 7, d[k] & 127, int.from_bytes(d[k + 1 : k + 4], "big")
        if first and (kind or size != 34 or k + 38 > len(d)):
            return None
        if first:
            total = int.from_bytes(d[k + 17 : k + 22], "big") & (1 << 36) - 1
        k, first = k + 4 + size, False
        if last:
            break
    end, done = None, 0
    while (head := _flac_header(d, k)) is not None:
        done += head[1]
        c, stop = 0, None
        for j in range(k, len(d)):
            c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ d[j]]
            if c == 0 and j >= k + head[0] + 2:
                stop = stop or j + 1
                if total and done >= total:
                    break
                if _flac_header(d, j + 1) is not None:
                    stop = j + 1
                    break
        if stop is None:
            break
        end = k = stop
        if total and done >= total:
            break
    return end - at if end is not None else None


def _ogg(d: memoryview, at: int) -> int | None:
    k = at
    while k + 27 <= len(d) and bytes(d[k : k + 5]) == b"OggS\0":
        n = d[k + 26]
        if k + 27 + n > len(d):
            return None
        last, k = d[k + 5] & 4, k + 27 + n + sum(d[k + 27 : k + 27 + n])
        if last:
            return k - at if k <= len(d) else None
    return None


def _mp4(d: memoryview, at: int) -> int | None:
    k, seen = at, set()
    while k + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, k)
        if size < 8 or k + size > len(d) or not bytes(name).isalnum():
            break
        seen.add(bytes(name))
        k += size
    return k - at if b"ftyp" in seen and len(seen) > 1 else None


# Magic bytes, where the object begins before them, type, validator.
MAGIC = (
    (b"RIFF", 0, "audio/wav", lambda d, at: _riff(d, at, b"WAVE")),
    (b"RIFF", 0, "image/webp", lambda d, at: _riff(d, at, b"WEBP")),
    (b"RIFF", 0, "video/avi", lambda d, at: _riff(d, at, b"AVI ")),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS\0\x02", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
)


def _automaton() -> ahocorasick.Automaton:
    by_magic: dict[bytes, list[int]] = {}
    for k, (magic, *_) in enumerate(MAGIC):
        by_magic.setdefault(magic, []).append(k)
    auto = ahocorasick.Automaton()
    for magic, ks in by_magic.items():
        auto.add_word(magic.decode("latin-1"), (len(magic), tuple(ks)))
    auto.make_automaton()
    return auto


_AUTO = _automaton()


def find(data: bytes) -> list[tuple[int, int, str]]:
    """Every confirmed object as (offset, length, type), by offset."""
    view, found = memoryview(data), set()
    for end, (size, ks) in _AUTO.iter(data.decode("latin-1")):
        for k in ks:
            _, back, kind, confirm = MAGIC[k]
            at = end + 1 - size - back
            if at >= 0 and (length := confirm(view, at)):
                found.add((at, length, kind))
    return sorted(found)


def samples(data: bytes, kind: str) -> bytes | None:
    """The bytes that ``store`` has kept in a WAVE stream, a PNG or a BMP; null for other types and layouts."""
    if kind == "audio/wav":
        k = 12
        while k + 8 <= len(data):
            name, size = struct.unpack_from("<4sI", data, k)
            if name == b"data":
                return data[k + 8 : k + 8 + size]
            k += 8 + size + (size & 1)
    if kind == "image/png":
        k, body, wide = 8, [], 0
        while k + 12 <= len(data):
            size, name = struct.unpack_from(">I4s", data, k)
            if name == b"IHDR":
                wide = struct.unpack_from(">I", data, k + 8)[0]
                if data[k + 16 : k + 21] != b"\x08\0\0\0\0":
                    return None
            elif name == b"IDAT":
                body.append(data[k + 8 : k + 8 + size])
            k += 12 + size
        try:
            rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
        except zlib.error:
            return None
        if not wide or len(rows) % (wide + 1):
            return None
        rows = rows.reshape(-1, wide + 1)
        return None if rows[:, 0].any() else rows[:, 1:].tobytes()
    if kind == "image/bmp":
        offset, wide, high, depth, packed = (struct.unpack_from(f, data, k)[0] for f, k in (("<I", 10), ("<i", 18), ("<i", 22), ("<H", 28), ("<I", 30)))
        if depth == 8 and high < 0 and wide % 4 == 0 and not packed:
            return data[offset : offset - wide * high]
    return None


def features(payload: bytes) -> str:
    """Signal features of 8-bit samples: mean, spread, entropy in thousandths, and changes of sign about the middle."""
    if not payload:
        return "samples=0"
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    v, total = np.arange(256), len(x)
    mean = int(n @ v) * 1000 // total
    spread = int((int(n @ (v * v)) * total - int(n @ v) ** 2) * 1000 // total**2)
    p = n[n > 0] / total
    high = x > 127
    return f"samples={total};mean={mean};var={spread};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};turns={int(np.count_nonzero(high[1:] != high[:-1]))}"


def _add(df: DataFrame, fields: list[tuple[str, str]], per_batch) -> DataFrame:
    taken = {c.lower() for c in df.columns}
    for name, _ in fields:
        if name in taken:
            raise ValueError(f"the input has a column {name!r} already")
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                s = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*s.columns, *per_batch(s)], [*s.schema.names, *(n for n, _ in fields)])

    return df.mapInArrow(run, schema)


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes and media: each whole text's UTF-8 bytes, filled up, in the form that their CRC picks."""

    def per_batch(b):
        raw = [(t or "").encode() for t in b.column(text).to_pylist()]
        full = [r + FILL * (max(1, -(-len(r) // UNIT)) * UNIT - len(r)) for r in raw]
        return [pa.array([len(r) for r in raw], pa.int64()), pa.array([_MADE[FORMS[zlib.crc32(f) % len(FORMS)]](f) for f in full], pa.binary())]

    return _add(df, [("n_bytes", "long"), ("media", "binary")], per_batch)


def sniff(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Adds media_type, corrected (the declared type was another), carved array<struct<at,length,type,sha256>>, payload (the samples of an 8-bit stream or image) and feature."""
    piece = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))

    def per_batch(b):
        kinds, wrong, carved, payloads, notes = [], [], [], [], []
        said = b.column(declared).to_pylist() if declared else [None] * b.num_rows
        for data, told in zip(b.column(media).to_pylist(), said, strict=True):
            data = data or b""
            found = find(data)
            kind = next((t for at, _, t in found if at == 0), UNKNOWN)
            inside = [{"at": at, "length": n, "type": t, "sha256": hashlib.sha256(data[at : at + n]).hexdigest()} for at, n, t in found if at]
            payload = samples(data, kind)
            if payload is None and kind == "application/zip" and inside:
                payload = samples(data[inside[0]["at"] : inside[0]["at"] + inside[0]["length"]], inside[0]["type"])
            kinds.append(kind)
            wrong.append(told is not None and told != kind)
            carved.append(inside)
            payloads.append(payload)
            notes.append(f"type={kind};carved={','.join(x['type'] for x in inside)};{features(payload or b'')}")
        return [pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, piece), pa.array(payloads, pa.binary()), pa.array(notes, pa.string())]

    return _add(df, [("media_type", "string"), ("corrected", "boolean"), ("carved", "array<struct<at:long,length:long,type:string,sha256:string>>"), ("payload", "binary"), ("feature", "string")], per_batch)
