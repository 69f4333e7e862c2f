"""Media columns: signature sniffing, validation, carving, and samples stored in a media format."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

#: Magic bytes (fixed values of the formats) by type, and where in the file they stand.
SIGNATURES = {
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "gif": (b"GIF8", 0),
    "bmp": (b"BM", 0),
    "wav": (b"WAVE", 8),
    "webp": (b"WEBP", 8),
    "ogg": (b"OggS", 0),
    "flac": (b"fLaC", 0),
    "mp4": (b"ftyp", 4),
    "pdf": (b"%PDF-", 0),
    "zip": (b"PK\x03\x04", 0),
    "gzip": (b"\x1f\x8b\x08", 0),
}


class Content(bytes):
    """Bytes of a cell that remember where end marks stand, so that each is looked for once, however many hits there are."""

    @cached_property
    def last_image_end(self) -> int:
        return self.rfind(b"\xff\xd9")

    @cached_property
    def last_page_end(self) -> int:
        return self.rfind(b"%%EOF")

    @cached_property
    def archives(self) -> dict[int, int]:
        """Begin -> end of the archives, by their directories' ends."""
        out: dict[int, int] = {}
        k = self.find(b"PK\x05\x06")
        while k >= 0 and k + 22 <= len(self):
            size, begin, note = struct.unpack_from("<IIH", self, k + 12)
            if k + 22 + note <= len(self):
                out.setdefault(k - begin - size, k + 22 + note)
            k = self.find(b"PK\x05\x06", k + 1)
        return out


def _png(data: Content, at: int) -> int | None:
    place = at + 8
    while place + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        end = place + 12 + size
        if end > len(data) or zlib.crc32(data[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if place == at + 8 and kind != b"IHDR":
            return None
        if kind == b"IEND":
            return end - at
        place = end
    return None


def _jpeg(data: Content, at: int) -> int | None:
    place = at + 2
    while place + 4 <= len(data):
        if data[place] != 0xFF:
            return None
        mark = data[place + 1]
        if mark == 0xFF:
            place += 1
            continue
        size = struct.unpack_from(">H", data, place + 2)[0]
        if size < 2:
            return None
        place += 2 + size
        if mark == 0xDA:
            return data.find(b"\xff\xd9", place) + 2 - at if place <= data.last_image_end else None
    return None


def _gif(data: Content, at: int) -> int | None:
    if bytes(data[at : at + 6]) not in (b"GIF87a", b"GIF89a") or at + 13 > len(data):
        return None
    flags = data[at + 10]
    place = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += 1 + data[place]
        return place + 1

    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 <= len(data):
            local = data[place + 9]
            place = blocks(place + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(data: Content, at: int) -> int | None:
    if at + 30 > len(data):
        return None
    size, zero, begin, head, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    good = zero == 0 and head in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= begin <= size
    return size if good and at + size <= len(data) else None


def _riff(form: bytes, need: tuple[bytes, ...]) -> Callable[[Content, int], int | None]:
    def valid(data: Content, at: int) -> int | None:
        if at + 12 > len(data) or bytes(data[at : at + 4]) != b"RIFF" or bytes(data[at + 8 : at + 12]) != form:
            return None
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        place, seen = at + 12, set()
        if end > len(data):
            return None
        while place + 8 <= end:
            kind, size = struct.unpack_from("<4sI", data, place)
            seen.add(kind)
            place += 8 + size + (size & 1)
        return end - at if place in (end, end + 1) and any(n in seen for n in need) else None

    return valid


def _ogg(data: Content, at: int) -> int | None:
    place = at
    while place + 27 <= len(data) and bytes(data[place : place + 5]) == b"OggS\0":
        n = data[place + 26]
        place += 27 + n + sum(data[place + 27 : place + 27 + n])
    return place - at if at < place <= len(data) else None


def _flac(data: Content, at: int) -> int | None:
    place, first = at + 4, True
    while place + 4 <= len(data):
        kind, size = data[place], int.from_bytes(data[place + 1 : place + 4], "big")
        if first and (kind & 127 or size != 34):
            return None
        place, first = place + 4 + size, False
        if kind & 128:
            return len(data) - at if place <= len(data) else None
    return None


def _mp4(data: Content, at: int) -> int | None:
    place, seen = at, 0
    while place + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        if size == 1 and place + 16 <= len(data):
            size = struct.unpack_from(">Q", data, place + 8)[0]
        if size < 8 or place + size > len(data) or not all(32 <= c < 127 for c in kind):
            break
        place, seen = place + size, seen + 1
    return place - at if seen > 1 else None


def _pdf(data: Content, at: int) -> int | None:
    return data.last_page_end + 5 - at if data.last_page_end > at else None


def _zip(data: Content, at: int) -> int | None:
    end = data.archives.get(at)
    return end - at if end else None


def _gzip(data: Content, at: int) -> int | None:
    reader = zlib.decompressobj(31)
    place = at
    try:
        while place < len(data) and not reader.eof:
            reader.decompress(bytes(data[place : place + 65536]))
            place += 65536
    except zlib.error:
        return None
    return min(place, len(data)) - len(reader.unused_data) - at if reader.eof else None


VALIDATORS: dict[str, Callable[[Content, int], int | None]] = {
    "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "wav": _riff(b"WAVE", (b"fmt ",)), "webp": _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X")),
    "ogg": _ogg, "flac": _flac, "mp4": _mp4, "pdf": _pdf, "zip": _zip, "gzip": _gzip,
}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, at) in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + at))
    found.make_automaton()
    return found


def find_media(content: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in content that no earlier one contains, by offset."""
    hits = sorted({(end - back, kind) for end, (kind, back) in _automaton().iter(content.decode("latin-1")) if end >= back})
    out, view, free = [], Content(content), 0
    for at, kind in hits:
        if at >= free and (length := VALIDATORS[kind](view, at)):
            out.append((kind, at, length))
            free = at + length
    return out


def sniff_media(media: DataFrame, key: str = "id", content: str = "content", declared: str | None = None) -> DataFrame:
    """One row per medium in a binary column: key, declared, type, corrected, media_index, offset, length,
    carved (its bytes).

    Magic bytes are located in one pass, structure and lengths are validated, and media inside other media are
    left in them. type is what the bytes say; corrected tells that another type was declared; media that
    begin after byte 0 are carved. Content without valid media (null, empty, text): one row with type null,
    media_index -1. Null keys are kept, repeated rows give repeated results, empty input an empty result.
    Columns other than the three are not read. Content is one cell, so its size is bounded by Spark's rows.
    """
    kind = media.schema[key].dataType.simpleString()
    rows = media.select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_content"), (F.lower(F.col(declared)) if declared else F.lit(None)).cast("string").alias("_declared"))

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for n, data in enumerate(batch.column(1).to_pylist()):
                found = find_media(data or b"")
                for k, (type_, at, length) in enumerate(found or [(None, None, None)]):
                    row.append(n)
                    out.append((type_, k if found else -1, at, length, data[at : at + length] if found else None))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())))],
                names=["_key", "_declared", "type", "media_index", "offset", "length", "carved"],
            )

    got = rows.mapInArrow(sniff, f"_key {kind}, _declared string, type string, media_index int, offset long, length long, carved binary")
    corrected = F.col("type").isNotNull() & F.col("_declared").isNotNull() & (F.col("type") != F.col("_declared"))
    return got.select(F.col("_key").alias(key), F.col("_declared").alias("declared"), "type", corrected.alias("corrected"), "media_index", "offset", "length", "carved")


RATE = 8000


def stored(payload: bytes) -> bytes:
    """payload as 8-bit mono samples of a wave file; its length is even."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(wave: bytes) -> bytes:
    """The samples of a valid wave file with 8-bit samples."""
    place = 12
    while place + 8 <= len(wave):
        kind, size = struct.unpack_from("<4sI", wave, place)
        if kind == b"data":
            return wave[place + 8 : place + 8 + size]
        place += 8 + size + (size & 1)
    raise ValueError("no samples")


def features(payload: bytes) -> str:
    """Level, spread, crossings of the middle and entropy of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    signed = x.astype(np.int16) - 128
    crossings = int(((signed[1:] < 0) != (signed[:-1] < 0)).sum())
    return f"wav/8bit/mono/{RATE}Hz n={len(x)} mean={x.mean():.4f} std={x.std():.4f} crossings={crossings} entropy={float(-(share * np.log2(share)).sum()):.4f}"


BLOCK = 64
#: What stands before the medium in a record of the query, and the type that the record declares, which is wrong.
RECORD, DECLARED = b"inkwell record.\n", "mp4"


def media_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, content and declared: each text as samples of a wave file inside a record that declares another type.

    The samples are the UTF-8 text (null: empty) and bytes 0 up to a positive multiple of BLOCK.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [d.as_buffer().to_pybytes() for d in batch.column(1)]
            files = [RECORD + stored(d + bytes(-len(d) % BLOCK or (0 if d else BLOCK))) for d in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in each], pa.int64()), pa.array(files, pa.binary())], names=["_key", "n_bytes", "content"])

    return rows.mapInArrow(lean(work), f"_key {rows.schema['_key'].dataType.simpleString()}, n_bytes long, content binary").withColumn("declared", F.lit(DECLARED))


def media_round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its text stored as a medium in a record, found there, read back and described.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type,
    media_offset, corrected. The records of media_records go through sniff_media, which finds the medium by its bytes,
    corrects the declared type and carves it; the samples come from what was carved. Null keys are kept, repeated rows give
    repeated results, empty input an empty result; other columns are not read.
    """
    records = media_records(docs, key, text)
    found = sniff_media(records.select(F.struct("_key", "n_bytes").alias("_id"), "content", "declared"), "_id", "content", "declared")
    found = found.filter("media_index = 0").select("_id.*", "type", "offset", "corrected", "carved")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for carved in batch.column(5):
                carved = carved.as_buffer().to_pybytes()
                back = samples(carved)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(carved), hashlib.sha256(carved).hexdigest(), features(back)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *batch.columns[2:5]], names=["_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "media_offset", "corrected"])

    schema = f"_key {records.schema['_key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, media_offset long, corrected boolean"
    return found.mapInArrow(lean(work), schema).withColumnRenamed("_key", key)
