import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from inkwell.llm.media import find_media, media_round_trip, samples, sniff_media, stored


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xyz\xff\0q\xff\xd9"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


FILES = {
    "png": png(), "bmp": bmp(), "gif": GIF, "jpeg": JPEG, "wav": stored(bytes(64)), "zip": zipped(), "gzip": gzip.compress(b"hello"), "pdf": b"%PDF-1.4 x\n%%EOF",
    "ogg": b"OggS\0\x02" + b"\0" * 20 + b"\x01\x03abc", "flac": b"fLaC\x80\0\0\x22" + b"\0" * 34, "mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"mdat"),
    "webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
}


def test_each_format_alone_and_inside_noise():
    for kind, data in FILES.items():
        assert find_media(data) == [(kind, 0, len(data))], kind
        inside = b"noise BM PK RIFF " + data
        assert (kind, 17, len(data)) in find_media(inside), kind
        if kind not in ("pdf", "flac"):
            assert not any(k == kind and n >= len(data) for k, _, n in find_media(data[:-1])), kind


def test_sniffing_rows(spark):
    rows = [(1, FILES["png"], "jpeg"), (2, b"text", "text"), (3, None, None), (4, b"x" + FILES["gif"] + b"yy" + FILES["bmp"], None), (None, b"", "png"), (1, FILES["png"], "png")]
    got = sniff_media(spark.createDataFrame(rows, "id long, content binary, type string"), declared="type").collect()
    assert sorted((str(r.id), r.type, r.corrected, r.media_index, r.offset) for r in got if r.type) == sorted([("1", "png", True, 0, 0), ("1", "png", False, 0, 0), ("4", "gif", False, 0, 1), ("4", "bmp", False, 1, 1 + len(GIF) + 2)])
    assert sum(r.type is None for r in got) == 3 and all(bytes(r.carved) in FILES.values() for r in got if r.type)
    assert sniff_media(spark.createDataFrame([], "id long, content binary")).count() == 0


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 64, "RIFF WAVE BM", "x" * 64, "y" * 100000, "x" * 64]
    docs = spark.createDataFrame([(k, t, "f") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in media_round_trip(docs).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert samples(stored(payload)) == payload and r.media_sha256 == hashlib.sha256(stored(payload)).hexdigest() and r.media_type == "wav"
        assert (r.media_offset, r.corrected, r.media_bytes) == (16, True, len(stored(payload)))
    assert got[5].feature == got[7].feature and media_round_trip(docs.limit(0)).count() == 0


def test_many_hits_take_linear_time():
    began = time.perf_counter()
    for data in (b"\xff\xd8\xff\xda\0\x02" * 100_000, b"%PDF-" * 200_000, b"PK\x03\x04" * 100_000 + b"PK\x05\x06" * 100_000):
        assert not [x for x in find_media(data) if x[0] != "jpeg"]
    assert time.perf_counter() - began < 20
