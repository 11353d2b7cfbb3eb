"""Header probes, PNG files and the packed layout."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.color import ParameterError
from rasterloom.operators import packed, pixelwise
from rasterloom.sources import headers, png

RNG = np.random.default_rng(3)
RASTER = RNG.integers(0, 256, (9, 13, 4), dtype=np.uint8)
JPEG = bytes.fromhex("FFD8 FFE0 0004 0000 FFFF C2 0011 08 0020 0040".replace(" ", "")) + bytes(12)
GIF = b"GIF89a" + struct.pack("<HHBBB", 0, 0, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\x01\x05\x00\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 5, 7, 0) + b"\x02\x02\x4c\x01\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 6, 3, 0) + b"\x02\x01\x00\x00"
WEBP = b"RIFF\x00\x00\x00\x00WEBPVP8L\x05\x00\x00\x00\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28)


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


AVIF = box(b"ftyp", b"mif1\x00\x00\x00\x00avif") + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", box(b"ispe", bytes(4) + struct.pack(">II", 30, 20)) + box(b"auxC", bytes(4) + b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\x00"))))


def test_probes(spark):
    files = [("jpeg", JPEG, (64, 32, 1, False)), ("gif", GIF, (6, 7, 2, True)), ("webp", WEBP, (100, 50, 1, True)), ("avif", AVIF, (30, 20, 1, True)), ("png", png.encode(RASTER), (13, 9, 1, True))]
    bad = [("jpeg", JPEG[:12], None), ("gif", GIF[:13], None), ("png", png.encode(RASTER)[:20], None), (None, b"text", None), (None, None, None), (None, b"", None)]
    rows = [(k, content) for k, (_, content, _) in enumerate(files + bad)]
    got = spark.createDataFrame(rows, "k int, content binary").select("k", headers.identify(F.col("content")).alias("f"), headers.probe(F.col("content")).alias("p")).orderBy("k").collect()
    for row, (name, _, want) in zip(got, files + bad, strict=True):
        assert row.f == name
        assert (row.p.width, row.p.height, row.p.frames, row.p.has_alpha) == (want or (None,) * 4)
        assert (row.p.error is None) == (want is not None)


def test_hostile_headers():
    riff = lambda body: b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body
    box = lambda kind, body, n=None: (8 + len(body) if n is None else n).to_bytes(4, "big") + kind + body
    extent = box(b"ispe", bytes(4) + (7).to_bytes(4, "big") + (5).to_bytes(4, "big"))
    good = {
        "webp": riff(b"VP8 " + (10).to_bytes(4, "little") + b"\0\0\0\x9d\x01\x2a\x07\0\x05\0"),
        "avif": box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", extent + box(b"auxC", bytes(4) + headers.ALPHA_URNS[0] + b"\0")))),
    }
    bad = [
        ("jpeg", b"\xff\xd8\xff\xe0\0\1" + bytes(20)),
        ("webp", riff(b"VP8 " + bytes(14))),
        ("webp", riff(b"VP8L" + (5).to_bytes(4, "little") + b"\x2e" + bytes(4))),
        ("webp", riff(b"VP8L" + (5).to_bytes(4, "little") + b"\x2f" + (1 << 29).to_bytes(4, "little"))),
        ("webp", riff(b"VP8X" + (10).to_bytes(4, "little") + b"\2" + bytes(9))),
        ("avif", box(b"meta", bytes(4) + extent, 4000)),
        ("avif", box(b"ispe", bytes(8))),
    ]
    assert headers.probe_bytes("webp", good["webp"]) == (7, 5, 1, False, None)
    assert headers.probe_bytes("avif", good["avif"]) == (7, 5, 1, True, None)
    for name, data in bad:
        assert headers.probe_bytes(name, data)[:4] == (None,) * 4 and headers.probe_bytes(name, data)[4]
    for name, data in good.items():
        for n in range(len(data)):
            headers.probe_bytes(name, data[:n])  # never raises


def test_brands_end_with_their_box(spark):
    def of(major, *brands):
        return box(b"ftyp", major + bytes(4) + b"".join(brands))

    wanted = [("avif", of(b"xxxx", *[b"yyyy"] * 40, b"avif")), ("avif", of(b"mif1", *[b"miaf"] * 13, b"avis")), ("heic", of(b"hevm")), ("heic", of(b"xxxx", b"hevs"))]
    wanted += [(None, of(b"xxxx", b"yyyy") + b"avif" * 3), (None, of(b"xxxx", b"yyav", b"ifyy")), (None, of(b"avif")[:15]), ("avif", of(b"avif")), ("heic", of(b"xxxx", b"heic")[:20]), (None, of(b"xxxx", b"heic")[:19])]
    wanted += [("heic", of(b"xxxx", b"yyyy", *[b"yyyy"] * 5000, b"heic")), (None, b"\xff\xff\xff\xffftypxxxx" + bytes(4) + b"yyyyhei"), ("heic", b"\x00\x00\x00\x00ftypheic" + bytes(4)), (None, b"\x00\x00\x00\x00ftypxxxx" + bytes(4) + b"heic")]
    rows = spark.createDataFrame([(k, c) for k, (_, c) in enumerate(wanted)], "k int, content binary")
    assert [r.f for r in rows.select("k", headers.identify(F.col("content")).alias("f")).orderBy("k").collect()] == [f for f, _ in wanted]


def test_png_round_trip_and_filters():
    for raster in (RASTER, np.dstack([RASTER[..., :3], np.full((9, 13), 255, np.uint8)]), RASTER[:1, :1]):
        assert (png.decode(png.encode(raster)) == raster).all()
    for kind in (1, 3, 4):  # a file that another program filtered
        rows, lines = RASTER.reshape(9, -1).astype(int), b""
        for y in range(9):
            line = []
            for i in range(52):
                a, b = rows[y][i - 4] if i > 3 else 0, rows[y - 1][i] if y else 0
                c = rows[y - 1][i - 4] if y and i > 3 else 0
                guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line.append((rows[y][i] - guess) % 256)
            lines += bytes([kind, *line])
        head = struct.pack(">IIBBBBB", 13, 9, 8, 6, 0, 0, 0)
        data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(lines)) + png._chunk(b"IEND", b"")
        assert (png.decode(data) == RASTER).all()
    with pytest.raises(ValueError):
        png.decode(png.encode(RASTER), most=10)
    with pytest.raises(ValueError):
        png.decode(png.encode(RASTER)[:-20] + b"xxxx" + png.encode(RASTER)[-16:])


def test_packed_layout(spark):
    h, w, _ = RASTER.shape
    rows = [(1, w, h, x, y, *map(int, RASTER[y, x])) for y in range(h) for x in range(w)] + [(2, 1, 1, 0, 0, 1, 2, 3, 4)]
    pixels = spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")
    wide = packed.pack(pixels)
    assert {r.image_id: bytes(r.data) for r in wide.collect()} == {1: RASTER.tobytes(), 2: bytes([1, 2, 3, 4])}
    assert sorted(map(tuple, packed.unpack(wide, 10).collect())) == sorted(rows)
    near = packed.unpack(packed.change(wide.filter("image_id = 1"), packed.resize(7, 5, "nearest")))
    same = pixelwise.resize_nearest(pixels.filter("image_id = 1"), 7, 5).select(near.columns)
    assert near.count() == 35 == same.count()


def test_kernels_keep_even_images():
    even = np.zeros((8, 10, 4), np.uint8)
    even[:] = (10, 200, 30, 128)
    for kernel in (packed.blur(2.0), packed.sharpen(3.0), *(packed.resize(17, 3, f) for f in ("nearest", "bilinear", "bicubic", "lanczos"))):
        assert np.abs(kernel(even).astype(int) - even[0, 0].astype(int)).max() <= 1
    assert packed.resize(17, 3)(even).shape == (3, 17, 4)
    assert (packed.resize(13, 9)(RASTER) == RASTER).all()


def test_rotation_about_the_centre():
    opaque = RASTER.copy()
    opaque[..., 3] = 255
    assert (packed.rotate(90)(opaque) == np.rot90(opaque, -1)).all()
    assert (packed.rotate(180)(opaque) == opaque[::-1, ::-1]).all()
    assert packed.rotate(45)(opaque).shape == (16, 16, 4)
    assert tuple(packed.rotate(45, (1, 2, 3, 255))(opaque)[0, 0]) == (1, 2, 3, 255)


def test_parameters():
    for bad in (lambda: packed.blur(0), lambda: packed.sharpen(9), lambda: packed.resize(0, 1), lambda: packed.resize(1, 1, "x")):
        with pytest.raises(ParameterError):
            bad()
