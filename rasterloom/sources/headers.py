"""Formats and sizes of image files from their first bytes, without decoding: a Catalyst test of magic bytes, and a probe per format.

`identify` stays in the JVM. `probe` walks segments, chunks or blocks, so it is an Arrow-fed function; it is asked only for files whose
format is known. A file whose header is broken gets a null size and the reason in `error`; no row is lost.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signatures that name each format, in hexadecimal digits.
MAGIC = {"jpeg": ["FFD8FF"], "png": ["89504E470D0A1A0A"], "gif": ["474946383761", "474946383961"]}
#: Brands of ISO base media files.
AVIF_BRANDS, HEIC_BRANDS = ("avif", "avis"), ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1")
MOST = 1_000_000_000
PROBED = "struct<width:int,height:int,frames:int,has_alpha:boolean,error:string>"


def identify(content: Column) -> Column:
    """jpeg, png, gif, webp, avif or heic; null for anything else."""
    head = F.hex(F.substring(content, 1, 64))
    test = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, starts in MAGIC.items():
        for start in starts:
            test = test.when(head.startswith(start), name)
    test = test.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    ftyp = (F.substring(head, 9, 8) == "66747970") & (F.length(head) >= 32)
    # the major brand, and what follows its version up to the end of the box, as far as whole brands go
    stop = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    more = F.least(F.greatest(stop, F.lit(16)), F.length(content).cast("long")).cast("int") - 16
    brands = F.hex(F.concat(F.substring(content, 9, 4), F.substring(content, F.lit(17), more - more % 4)))
    for name, known in (("avif", AVIF_BRANDS), ("heic", HEIC_BRANDS)):
        alike = "|".join(brand.encode().hex().upper() for brand in known)
        test = test.when(ftyp & F.regexp_like(brands, F.lit(f"^(?:.{{8}})*?(?:{alike})")), name)
    return test


class Broken(ValueError):
    """A header that ends early or says what can't be."""


def _u(data: bytes, at: int, n: int, order: str = "big") -> int:
    if at < 0 or at + n > len(data):
        raise Broken("the file ends early")
    return int.from_bytes(data[at : at + n], order)


def probe_jpeg(d: bytes) -> tuple[int, int, int, bool]:
    """Sizes of the first frame header, at any of the sixteen start-of-frame markers but tables and arithmetic conditioning."""
    at = 2
    while True:
        if _u(d, at, 1) != 0xFF:
            raise Broken("no marker where one must be")
        while _u(d, at, 1) == 0xFF:
            at += 1
        marker = d[at]
        at += 1
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        if marker in (0xD9, 0xDA):
            raise Broken("image data before a frame header")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return _u(d, at + 5, 2), _u(d, at + 3, 2), 1, False
        length = _u(d, at, 2)
        if length < 2:
            raise Broken("a segment shorter than its length")
        at += length


def probe_png(d: bytes) -> tuple[int, int, int, bool]:
    if _u(d, 8, 4) != 13 or d[12:16] != b"IHDR":
        raise Broken("the first chunk isn't a header")
    kind = _u(d, 25, 1)
    if kind not in (0, 2, 3, 4, 6):
        raise Broken("no such color type")
    alpha, at = kind in (4, 6), 33
    while not alpha and at + 8 <= len(d) and d[at + 4 : at + 8] != b"IDAT":
        alpha = d[at + 4 : at + 8] == b"tRNS"
        at += 12 + _u(d, at, 4)
    return _u(d, 16, 4), _u(d, 20, 4), 1, alpha


def gif_blocks(d: bytes):
    """(kind, place, packed byte) of each block: "control" or "image". A missing trailer ends the walk as a trailer does."""

    def past(at: int) -> int:
        while n := _u(d, at, 1):
            at += n + 1
        return at + 1

    flags = _u(d, 10, 1)
    at = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while at < len(d) and d[at] != 0x3B:
        if d[at] == 0x21:
            if _u(d, at + 1, 1) == 0xF9:
                yield "control", at + 2, _u(d, at + 3, 1)
            at = past(at + 2)
        elif d[at] == 0x2C:
            flags = _u(d, at + 9, 1)
            yield "image", at + 1, flags
            at = past(at + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            raise Broken("no such block")


def probe_gif(d: bytes) -> tuple[int, int, int, bool]:
    frames, w, h, alpha = 0, 0, 0, False
    for kind, at, flags in gif_blocks(d):
        if kind == "control":
            alpha |= bool(flags & 1)
        else:
            frames, w, h = frames + 1, max(w, _u(d, at + 4, 2, "little")), max(h, _u(d, at + 6, 2, "little"))
    if not frames:
        raise Broken("no image")
    screen = _u(d, 6, 2, "little"), _u(d, 8, 2, "little")
    return (*(screen if all(screen) else (w, h)), frames, alpha)


def probe_webp(d: bytes) -> tuple[int, int, int, bool]:
    """The canvas; frames are counted up to the end that the container states, if the file says that it moves."""
    kind, flags = d[12:16], _u(d, 20, 1)
    if kind == b"VP8 ":
        if d[23:26] != b"\x9d\x01\x2a":
            raise Broken("no start code of a lossy image")
        return _u(d, 26, 2, "little") & 0x3FFF, _u(d, 28, 2, "little") & 0x3FFF, 1, False
    if kind == b"VP8L":
        bits = _u(d, 21, 4, "little")
        if flags != 0x2F or bits >> 29:
            raise Broken("no signature or version of a lossless image")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1, bool(bits >> 28 & 1)
    if kind != b"VP8X":
        raise Broken("no such first chunk")
    frames, at, stop = 0, 12, min(len(d), _u(d, 4, 4, "little") + 8)
    while flags & 2 and at + 8 <= stop:
        n = _u(d, at + 4, 4, "little")
        if d[at : at + 4] == b"ANMF":
            _u(d, at + 14, 6)  # the frame's size must be there
            frames += 1
        at += 8 + n + n % 2
    if flags & 2 and not frames:
        raise Broken("an animation without frames")
    return _u(d, 24, 3, "little") + 1, _u(d, 27, 3, "little") + 1, max(1, frames), bool(flags & 16)


#: URNs of alpha planes: fixed values.
ALPHA_URNS = (b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", b"urn:mpeg:hevc:2015:auxid:1")


def probe_boxes(d: bytes) -> tuple[int, int, int, bool]:
    """AVIF and HEIC: the largest of all extents in the property boxes; alpha by the URN of an auxiliary image."""
    sizes, alpha, seen = [], False, 0
    stack = [(0, len(d), 0)]
    while stack:
        at, end, depth = stack.pop()
        while at + 8 <= end:
            seen += 1
            if seen > 10_000:
                raise Broken("too many boxes")
            n, kind, head = _u(d, at, 4), d[at + 4 : at + 8], 8
            if n == 1:
                n, head = _u(d, at + 8, 8), 16
            n = end - at if n == 0 else n
            if n < head or n > end - at:
                raise Broken("a box shorter than its head or longer than what holds it")
            body, stop = at + head, at + n
            if depth < 4 and kind == b"meta":
                stack.append((body + 4, stop, depth + 1))
            elif depth < 4 and kind in (b"iprp", b"ipco"):
                stack.append((body, stop, depth + 1))
            elif kind == b"ispe":
                if stop - body < 12:
                    raise Broken("an extent too short")
                sizes.append((_u(d, body + 4, 4), _u(d, body + 8, 4)))
            elif kind == b"auxC":
                name, ended, _ = d[body + 4 : stop].partition(b"\0")
                alpha |= bool(ended) and name in ALPHA_URNS
            at += n
    if not sizes:
        raise Broken("no extent")
    return max(w for w, _ in sizes), max(h for _, h in sizes), 1, alpha


PROBES = {"jpeg": probe_jpeg, "png": probe_png, "gif": probe_gif, "webp": probe_webp, "avif": probe_boxes, "heic": probe_boxes}


def probe_bytes(name: str | None, data: bytes | None) -> tuple:
    if name is None or data is None:
        return None, None, None, None, "no known format"
    try:
        w, h, frames, alpha = PROBES[name](bytes(data))
        if min(w, h) < 1:
            raise Broken("a side of no pixels")
        if max(w, h) > MOST:
            raise Broken("a side over the limit")
        return w, h, frames, alpha, None
    except (Broken, IndexError, struct.error) as e:
        return None, None, None, None, str(e) or "the file ends early"


def probe(content: Column, name: Column | None = None) -> Column:
    """PROBED of each file; name is its format, as identify(content) gives it."""

    @F.pandas_udf(PROBED)
    def run(names: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([probe_bytes(n, d) for n, d in zip(names, data, strict=True)], columns=["width", "height", "frames", "has_alpha", "error"])
        return out.astype({"width": "Int32", "height": "Int32", "frames": "Int32", "has_alpha": "boolean"})

    return run(identify(content) if name is None else name, content)
