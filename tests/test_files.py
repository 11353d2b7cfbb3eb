"""Files, orientation, GIF animations, marks: golden values, other readers and brute force."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.color import ParameterError
from rasterloom.operators import marks, packed
from rasterloom.sources import exif, files, gif, headers, png

RNG = np.random.default_rng(5)
RASTER = RNG.integers(0, 256, (9, 13, 4), dtype=np.uint8)
OPAQUE = np.dstack([RNG.integers(40, 200, (256, 248, 3), dtype=np.uint8), np.full((256, 248), 255, np.uint8)])


def few_colors(shape, n):
    table = RNG.integers(0, 256, (n, 4), dtype=np.uint8)
    table[:, 3] = 255
    table[0] = 0
    return table[RNG.integers(0, n, shape)]


def jvm_raster(spark, data):
    """What the JVM's own reader makes of the first picture in a file."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    w, h = picture.getWidth(), picture.getHeight()
    argb = np.array([[picture.getRGB(x, y) & 0xFFFFFFFF for x in range(w)] for y in range(h)], np.uint32)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=2).astype(np.uint8)


def test_gif_round_trip(spark):
    for shape, n in (((1, 1), 1), ((9, 13), 4), ((40, 40), 2), ((70, 90), 256), ((120, 130), 200)):
        frames = [(few_colors(shape, n), d) for d in (100, 50, 0)]
        got = gif.decode(gif.encode(frames, 3))
        assert all((a == b).all() and d == e for (a, d), (b, e) in zip(got, frames, strict=True))
    small = few_colors((20, 30), 60)
    seen = jvm_raster(spark, gif.encode([(small, 0)], 1))
    assert (seen[..., 3] == small[..., 3]).all() and (seen[small[..., 3] > 0] == small[small[..., 3] > 0]).all()
    assert [gif.read(gif.encode([(small, 0)], n)).plays for n in (0, 1, 2, 65536)] == [0, 1, 2, 65536]
    many = np.dstack([RNG.integers(0, 256, (64, 64, 3), dtype=np.uint8), np.full((64, 64), 255, np.uint8)])
    (back, _), = gif.decode(gif.encode([(many, 0)]))
    assert np.abs(back.astype(int) - many).max() < 64
    for n in (0, 1, 5, 300, 30000):
        for size in (2, 3, 8):
            for values in (bytes(n), bytes(RNG.integers(0, 1 << size, n, dtype=np.uint8))):
                assert gif.unpacked(gif.packed_codes(values, size), size, n).tobytes() == values


def movie(*frames, screen=(3, 2)):
    """frames: (left, top, rows of color numbers, disposal, clear number)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *screen, 0x81, 0, 0) + bytes([9, 9, 9, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for left, top, rows, disposal, clear in frames:
        codes = gif.packed_codes(bytes(sum(rows, [])), 2)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0\x2c"
        out += struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), 0) + bytes([2, len(codes)]) + codes + b"\0"
    return out + b"\x3b"


def shown(data):
    names = {(9, 9, 9, 255): "0", (255, 0, 0, 255): "1", (0, 255, 0, 255): "2", (0, 0, 255, 255): "3", (0, 0, 0, 0): "."}
    return ["/".join("".join(names[tuple(map(int, p))] for p in row) for row in raster) for raster, _ in gif.decode(data)]


def test_gif_disposals():
    full = (0, 0, [[1, 1, 1], [1, 1, 1]])
    assert shown(movie((*full, 1, None), (1, 0, [[2]], 1, None), (0, 0, [[3]], 0, None))) == ["111/111", "121/111", "321/111"]
    assert shown(movie((*full, 1, None), (1, 0, [[2]], 2, None), (0, 0, [[3]], 0, None))) == ["111/111", "121/111", "3.1/111"]
    assert shown(movie((*full, 1, None), (1, 0, [[2]], 3, None), (0, 0, [[3]], 0, None))) == ["111/111", "121/111", "311/111"]
    assert shown(movie((*full, 5, None), (1, 0, [[2, 0]], 1, 0))) == ["111/111", "121/111"]  # reserved disposals stay; 0 is clear
    assert shown(movie((2, 1, [[2, 2], [2, 2]], 2, None), (5, 5, [[1]], 1, None))) == [".../..2", ".../..."]  # cut at the canvas
    assert shown(movie((1, 1, [[2]], 1, None), screen=(0, 0))) == ["../.2"]


def test_broken_gifs():
    good = movie((0, 0, [[1, 2, 3], [3, 2, 1]], 1, None))
    for bad in (good[:20], good[:13] + b"\x3b", good[:25] + b"\x07" + good[25:], b"GIF88a" + good[6:]):
        with pytest.raises(headers.Broken):
            gif.decode(bad)
    with pytest.raises(headers.Broken):
        gif.decode(good, most=5)
    for n in range(len(good)):
        try:
            gif.decode(good[:n])
        except headers.Broken:
            pass


def jpeg_with(tiff):
    body = exif.EXIF + tiff
    return b"\xff\xd8\xff\xe0\0\x04\0\0\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"


def test_orientation():
    plain = png.encode(RASTER)
    for k in range(1, 9):
        for order in ("little", "big"):
            tiff = exif.directory(k, order)
            webp = b"RIFF\0\0\0\0WEBPXXXX\x03\0\0\0abc\0EXIF" + (6 + len(tiff)).to_bytes(4, "little") + exif.EXIF + tiff
            assert exif.orientation_bytes("jpeg", jpeg_with(tiff)) == k
            assert exif.orientation_bytes("png", plain[:33] + png._chunk(b"eXIf", tiff) + plain[33:]) == k
            assert exif.orientation_bytes("webp", webp) == k
    assert exif.orientation_bytes("jpeg", jpeg_with(exif.directory(9))) == 1
    assert exif.orientation_bytes("gif", b"GIF89a") == exif.orientation_bytes(None, None) == exif.orientation_bytes("png", plain) == 1
    assert exif.orientation_bytes("png", plain + png._chunk(b"eXIf", exif.directory(6))) == 1  # after the data
    whole = jpeg_with(exif.directory(6))
    assert all(exif.orientation_bytes("jpeg", whole[:n]) == 1 for n in range(len(whole) - 10))


def test_turned():
    for k, want in {1: "ab/cd", 2: "ba/dc", 3: "dc/ba", 4: "cd/ab", 5: "ac/bd", 6: "ca/db", 7: "db/ca", 8: "bd/ac"}.items():
        letters = np.array([[ord(c)] * 4 for c in "abcd"], np.uint8).reshape(2, 2, 4)
        assert "/".join("".join(chr(p[0]) for p in row) for row in files.turned(letters, k)) == want


def test_files(spark, tmp_path):
    jvm = spark._jvm
    (tmp_path / "in" / "deep").mkdir(parents=True)
    content = {"a.png": png.encode(RASTER), "b.gif": movie((0, 0, [[1, 2, 3], [3, 2, 1]], 1, None)), "deep/c.bin": png.encode(RASTER[:2, :3]), "d.png": png.encode(RASTER)[:-20], "e.txt": b"text", "f.png": b"\x89"}
    for name, data in content.items():
        (tmp_path / "in" / name).write_bytes(data)
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            picture.setRGB(x, y, 0xC86432)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "in" / "g.jpg")))
    rows = files.read(spark, str(tmp_path / "in")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    said = {r.name: r for r in files.inspect(rows).collect()}
    assert {n: r.format for n, r in said.items()} == {"a.png": "png", "b.gif": "gif", "c.bin": "png", "d.png": "png", "e.txt": None, "f.png": None, "g.jpg": "jpeg"}
    assert (said["g.jpg"].width, said["g.jpg"].height, said["g.jpg"].error) == (16, 8, None)
    got = {r.name: r for r in files.decode(rows, "name").collect()}
    assert bytes(got["a.png"].data) == RASTER.tobytes() and (got["c.bin"].width, got["c.bin"].height) == (3, 2)
    assert all(got[n].error and got[n].data is None for n in ("d.png", "e.txt", "f.png", "g.jpg")) and got["b.gif"].delay_ms == 50
    assert {r.name for r in files.decode(rows, "name", mode="dropmalformed").collect()} == {"a.png", "b.gif", "c.bin"}
    with pytest.raises(Exception):  # noqa: B017
        files.decode(rows, "name", mode="failfast").collect()
    assert {r.name: r.error for r in files.decode(rows, "name", {"width": 5}).collect()}["a.png"] == "width is 13, the limit is 5"
    with pytest.raises(ParameterError):
        files.decode(rows, "name", mode="x")
    (jpeg,) = files.read_jpeg(spark, str(tmp_path / "in")).collect()
    pixels = np.frombuffer(bytes(jpeg.data), np.uint8).reshape(8, 16, 4).astype(int)
    assert (jpeg.width, jpeg.height) == (16, 8) and np.abs(pixels - [0xC8, 0x64, 0x32, 255]).max() < 8


def test_sinks(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.png").write_bytes(b"old")
    rows = spark.createDataFrame([("a.png", b"new"), ("b.png", b""), ("../c", b"x"), ("d", None), (None, b"x"), ("n/e", b"x")], "name string, content binary")
    got = {r.name: r for r in files.save(rows, str(out)).collect()}
    assert (got["a.png"].byte_count, got["b.png"].byte_count) == (3, 0) and all(got[n].error for n in ("../c", "d", None, "n/e"))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {"a.png": b"new", "b.png": b""}
    uri = spark.createDataFrame([(png.SIGNATURE + bytes(90),), (b"GIF89a",), (b"text",)], "content binary").select(files.data_uri(F.col("content")).alias("u")).collect()
    assert uri[0].u.startswith("data:image/png;base64,iVBORw0KGgo") and "\n" not in uri[0].u and uri[1].u == "data:image/gif;base64,R0lGODlh" and uri[2].u is None


def test_lsb_marks():
    payload = b"by hand"
    bits = "".join(f"{b:08b}" for b in marks.framed(payload, marks.LSB, None))
    got, at = marks.LsbMark().embed(RASTER_OPAQUE, payload), 0
    for k, value in enumerate(RASTER_OPAQUE.ravel().tolist()):  # by hand, in pixel order
        if k % 4 < 3 and RASTER_OPAQUE.reshape(-1, 4)[k // 4, 3] == 255 and at < len(bits):
            value, at = value & 0xFE | int(bits[at]), at + 1
        assert got.ravel()[k] == value
    assert at == len(bits)
    one, other = marks.LsbMark(b"key"), marks.LsbMark(b"another")
    marked = one.embed(OPAQUE, payload)
    assert one.read(marked) == ("authentic", payload) and other.read(marked) == ("absent", None) == marks.LsbMark().read(marked)
    assert marks.LsbMark().read(got) == ("intact", payload) and one.read(got) == ("absent", None)
    hurt = got.copy()
    place = marks.Slots(got, None).first(8 * 8)[-1]  # a bit of the payload
    hurt.reshape(-1)[place] ^= 1
    assert marks.LsbMark().read(hurt)[0] == "tampered"
    assert marks.LsbMark().read(RASTER[:1, :1]) == ("absent", None)
    with pytest.raises(ParameterError):
        marks.LsbMark().embed(RASTER[:2], payload)


RASTER_OPAQUE = RASTER.copy()
RASTER_OPAQUE[..., 3] = np.where(np.arange(13) % 5 == 0, 200, 255)


def test_dct_marks():
    for mark, status in ((marks.DctMark(), "intact"), (marks.DctMark(b"key"), "authentic"), (marks.DctMark(b"key", 60), "authentic")):
        marked = mark.embed(OPAQUE, b"twenty four bytes at most"[:24])
        assert mark.read(marked) == (status, b"twenty four bytes at most"[:24])
        noisy = marked.copy()
        noisy[..., :3] += RNG.integers(0, 4, noisy[..., :3].shape, dtype=np.uint8)
        assert mark.read(noisy)[0] == status and mark.read(OPAQUE) == ("absent", None)
    assert marks.DctMark(b"other").read(marked) == ("absent", None) == marks.DctMark().read(RASTER)
    with pytest.raises(ParameterError):
        marks.DctMark().embed(RASTER, b"x")
    with pytest.raises(ParameterError):
        marks.DctMark(strength=3)
    gap = marks.DctMark._gaps(None, marks.DctMark._tiles(OPAQUE))[0, 0]
    light = OPAQUE[:8, :8, :3] @ np.array([0.299, 0.587, 0.114])
    wave = lambda k, u: np.cos((2 * k + 1) * u * np.pi / 16)
    want = sum(0.25 * light[y, x] * (wave(x, 2) * wave(y, 1) - wave(x, 1) * wave(y, 2)) for y in range(8) for x in range(8))
    assert abs(gap - want) < 1e-9


def test_walk():
    """First numbers of xoshiro256** from the state 1, 2, 3, 4, as its authors' program gives them."""
    walk = marks.Walk(b"".join(k.to_bytes(8, "little") for k in (1, 2, 3, 4)))
    assert [walk.draw() for _ in range(4)] == [11520, 0, 1509978240, 1215971899390074240]
    walk = marks.Walk(hashlib.sha256(b"x").digest())
    assert sorted(walk.shuffled(50)) == list(range(50)) and all(walk.below(7) < 7 for _ in range(100)) and walk.below(1) == 0


def test_marks_of_tables(spark):
    rows = [(1, 248, 256, OPAQUE.tobytes(), b"one"), (2, 13, 9, RASTER_OPAQUE.tobytes(), b""), (3, 1, 1, bytes(4), b"three"), (4, 13, 9, RASTER_OPAQUE.tobytes(), None)]
    own = spark.createDataFrame(rows, packed.PACKED + ", mark binary")
    done = marks.embed(own, marks.LsbMark(), "mark")
    assert {r.image_id: r.error is None for r in done.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {(r.image_id, r.status, r.payload and bytes(r.payload)) for r in marks.read(done, marks.LsbMark()).collect()} == {(1, "intact", b"one"), (2, "absent", None), (3, "absent", None), (4, "absent", None)}
    for bad in (b"", bytes(4097)):
        with pytest.raises(ParameterError):
            marks.embed(own, marks.LsbMark(), bad)


def test_thumbnail():
    wide = few_colors((10, 40), 9)
    assert packed.thumbnail(8, 8)(wide).shape == (8, 8, 4)
    assert (packed.thumbnail(10, 10, "left")(wide) == wide[:, :10]).all() and (packed.thumbnail(10, 10, "bottom-right")(wide) == wide[:, 30:]).all()
    assert packed.thumbnail(20, 20)(wide).shape == (20, 20, 4)
    with pytest.raises(ParameterError):
        packed.thumbnail(20, 20, upscale=False)(wide)
    with pytest.raises(ParameterError):
        packed.thumbnail(8, 8, "middle")
