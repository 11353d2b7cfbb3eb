"""Files without metadata, not encoded anew: what decoding needs stays, and by default what colors need; everything else goes, known or not."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.sources.exif import _piece
from rasterloom.sources.headers import Broken, _u, identify
from rasterloom.sources.png import SIGNATURE

# Chunks that hold an image, and those that say its colors.
PNG_IMAGE, PNG_COLOR = (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"acTL", b"fcTL", b"fdAT"), (b"iCCP", b"sRGB", b"gAMA", b"cHRM", b"cICP")
WEBP_IMAGE, WEBP_FRAME = (b"VP8 ", b"VP8L", b"ALPH", b"ANIM"), (b"VP8 ", b"VP8L", b"ALPH")
STRIPPED = "struct<content:binary,error:string>"


def _png(d: bytes, colors: bool) -> bytes:
    out, at = [SIGNATURE], 8
    while at + 12 <= len(d):
        n, kind = _u(d, at, 4), d[at + 4 : at + 8]
        whole = _piece(d, at, n + 12)
        at += n + 12
        if kind in PNG_IMAGE or (colors and kind in PNG_COLOR and kind != b"iCCP"):
            out.append(whole)
        elif kind == b"iCCP" and colors:
            name, ended, rest = whole[8:-4].partition(b"\0")
            if ended and 1 <= len(name) <= 79:  # the name is free text, so it goes; the profile stays as it is
                body = kind + b"ICC Profile\0" + rest
                out.append(struct.pack(">I", len(body) - 4) + body + struct.pack(">I", zlib.crc32(body)))
        elif kind[:1].isupper() and kind not in PNG_COLOR:
            raise Broken("an unknown chunk that decoders need")
        if kind == b"IEND":
            return b"".join(out)
    raise Broken("no end")


def _segment(marker: int, body: bytes, colors: bool) -> bytes:
    """A JPEG segment as it stays, or nothing."""
    image = 0xC0 <= marker <= 0xCF or 0xDB <= marker <= 0xDF
    if marker == 0xE0 and body.startswith(b"JFIF\0") and len(body) >= 14:
        body, image = body[:12] + b"\0\0", True  # without its small picture
    profile = marker == 0xE2 and colors and body.startswith(b"ICC_PROFILE\0")
    if image or profile or (marker == 0xEE and body.startswith(b"Adobe")):
        return struct.pack(">BBH", 255, marker, len(body) + 2) + body
    return b""


def _jpeg(d: bytes, colors: bool) -> bytes:
    out, at = [b"\xff\xd8"], 2
    while True:
        if _u(d, at, 1) != 0xFF:
            raise Broken("no marker where one must be")
        while _u(d, at + 1, 1) == 0xFF:
            at += 1
        marker = d[at + 1]
        if marker == 0xD9:
            return b"".join([*out, b"\xff\xd9"])
        if marker in (0, 0xD8):
            raise Broken("a marker that can't be here")
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            out.append(d[at : at + 2])
            at += 2
            continue
        n = _u(d, at + 2, 2)
        if n < 2:
            raise Broken("a segment shorter than its length")
        segment = _piece(d, at, n + 2)
        at += n + 2
        if marker != 0xDA:
            out.append(_segment(marker, segment[4:], colors))
            continue
        end = at  # coded data runs to a marker that is neither stuffing nor a restart
        while True:
            end = d.find(b"\xff", end)
            if end < 0 or end + 1 >= len(d):
                raise Broken("no end")
            if d[end + 1] and not 0xD0 <= d[end + 1] <= 0xD7:
                break
            end += 2
        out.append(segment + d[at:end])
        at = end


def _webp_chunks(d: bytes, at: int, end: int):
    while at + 8 <= end:
        n = _u(d, at + 4, 4, "little")
        yield d[at : at + 4], d[at : min(at + 8 + n + n % 2, end)]
        at += 8 + n + n % 2


def _webp(d: bytes, colors: bool) -> bytes:
    out = []
    for kind, whole in _webp_chunks(d, 12, min(len(d), _u(d, 4, 4, "little") + 8)):
        if kind in WEBP_IMAGE or (kind == b"ICCP" and colors):
            out.append(whole)
        elif kind == b"VP8X" and len(whole) > 8:
            out.append(whole[:8] + bytes([whole[8] & ~(0x0C if colors else 0x2C)]) + whole[9:])
        elif kind == b"ANMF" and len(whole) >= 24:
            body = whole[8:24] + b"".join(c for k, c in _webp_chunks(whole, 24, len(whole)) if k in WEBP_FRAME)
            out.append(kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2))
    body = b"WEBP" + b"".join(out)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def strip_bytes(name: str | None, data: bytes | None, colors: bool = True) -> bytes | None:
    """The file without metadata; GIF, AVIF and HEIC files, and what is no image, stay as they are."""
    how = {"png": _png, "jpeg": _jpeg, "webp": _webp}.get(name or "")
    return data if how is None or data is None else how(bytes(data), colors)


def strip(content: Column, name: Column | None = None, colors: bool = True) -> Column:
    """STRIPPED of each file: its new bytes, or null and the reason where it is broken."""

    def one(n: str | None, d: bytes | None) -> tuple:
        try:
            return strip_bytes(n, d, colors), None
        except Broken as e:
            return None, str(e)

    @F.pandas_udf(STRIPPED)
    def run(names: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(n, d) for n, d in zip(names, data, strict=True)], columns=["content", "error"])

    return run(identify(content) if name is None else name, content)
