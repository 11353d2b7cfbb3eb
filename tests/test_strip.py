"""Files without metadata: what stays, what goes, and broken files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import exif, headers, png, strip

RASTER = np.random.default_rng(2).integers(0, 256, (5, 7, 4), dtype=np.uint8)
PLAIN = png.encode(RASTER)


def with_chunks(*chunks):
    return PLAIN[:33] + b"".join(png._chunk(k, b) for k, b in chunks) + PLAIN[33:]


def segment(marker, body):
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def test_png():
    full = with_chunks((b"tEXt", b"a\0b"), (b"eXIf", exif.directory(6)), (b"gAMA", bytes(4)), (b"iCCP", b"my name\0\0xyz")) + b"after the end"
    out = strip.strip_bytes("png", full)
    assert out == with_chunks((b"gAMA", bytes(4)), (b"iCCP", b"ICC Profile\0\0xyz")) and (png.decode(out) == RASTER).all()
    assert strip.strip_bytes("png", full, colors=False) == PLAIN and strip.strip_bytes("png", with_chunks((b"iCCP", b"\0\0x"))) == PLAIN
    for bad in (with_chunks((b"NEWc", b"")), PLAIN[:-12], PLAIN[:40]):
        with pytest.raises(headers.Broken):
            strip.strip_bytes("png", bad)


def test_jpeg():
    jfif = b"JFIF\0\1\1\0\0\1\0\1\2\2" + bytes(12)
    table, scan = segment(0xDB, bytes(65)), segment(0xDA, bytes(6)) + b"ab\xff\0cd\xff\xd3ef"
    profile, adobe = segment(0xE2, b"ICC_PROFILE\0\1\1data"), segment(0xEE, b"Adobe" + bytes(7))
    kept = segment(0xE0, jfif[:12] + b"\0\0") + adobe + table
    full = b"\xff\xd8" + segment(0xE0, jfif) + segment(0xE1, exif.EXIF + exif.directory(6)) + segment(0xFE, b"note") + b"\xff" + adobe + profile + segment(0xE2, b"MPF\0") + table + scan + scan + b"\xff\xd9trailer"
    assert strip.strip_bytes("jpeg", full, False) == b"\xff\xd8" + kept + scan + scan + b"\xff\xd9"
    assert strip.strip_bytes("jpeg", full) == b"\xff\xd8" + kept[: -len(table)] + profile + table + scan + scan + b"\xff\xd9"
    for bad in (full[:40], b"\xff\xd8" + scan, b"\xff\xd8\xff\0\0\2", b"\xff\xd8\xff\xe1\0\1", b"\xff\xd8ab"):
        with pytest.raises(headers.Broken):
            strip.strip_bytes("jpeg", bad)


def test_webp():
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    riff = lambda *chunks: b"RIFF" + struct.pack("<I", 4 + len(b"".join(chunks))) + b"WEBP" + b"".join(chunks)
    head = lambda flags: chunk(b"VP8X", bytes([flags]) + bytes(9))
    lossless, frame = chunk(b"VP8L", b"abc"), bytes(16)
    moving = lambda *more: chunk(b"ANMF", frame + lossless + b"".join(more))
    full = riff(head(0x3E), chunk(b"ICCP", b"p"), chunk(b"ANIM", bytes(6)), moving(chunk(b"XXXX", b"y")), chunk(b"EXIF", b"e"), chunk(b"XMP ", b"x"), chunk(b"????", b"z")) + b"after"
    assert strip.strip_bytes("webp", full) == riff(head(0x32), chunk(b"ICCP", b"p"), chunk(b"ANIM", bytes(6)), moving())
    assert strip.strip_bytes("webp", full, False) == riff(head(0x12), chunk(b"ANIM", bytes(6)), moving())


def test_tables(spark):
    rows = [(0, with_chunks((b"tEXt", b"x"))), (1, PLAIN[:-12]), (2, b"GIF89a"), (3, b"text"), (4, None)]
    got = {r.k: r for r in spark.createDataFrame(rows, "k int, content binary").select("k", strip.strip(F.col("content")).alias("s")).collect()}
    assert bytes(got[0].s.content) == PLAIN and got[1].s.content is None and got[1].s.error
    assert bytes(got[2].s.content) == b"GIF89a" and bytes(got[3].s.content) == b"text" and got[4].s.content is None
