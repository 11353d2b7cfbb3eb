"""PNG bytes from RGBA rasters and back, with numpy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = bytes.fromhex("89504E470D0A1A0A")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(rgba: np.ndarray, level: int = 6, keep_alpha: bool = False) -> bytes:
    """8-bit PNG of a (height, width, 4) raster; the alpha channel of an opaque one is left out unless keep_alpha."""
    if not 0 <= level <= 9:
        raise ValueError("a level is from 0 to 9")
    h, w, _ = rgba.shape
    whole = keep_alpha or bool((rgba[..., 3] < 255).any())
    rows = np.ascontiguousarray(rgba if whole else rgba[..., :3]).reshape(h, -1).astype(np.uint8)
    # filter 2: each row less the one above
    less = rows.copy()
    less[1:] -= rows[:-1]
    lines = np.concatenate([np.full((h, 1), 2, np.uint8), less], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if whole else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(data, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, row, up = lines[y, 0], lines[y, 1:], out[y]
        now = out[y + 1]
        if kind == 0:
            now[:] = row
        elif kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            now[:] = row + up
        elif kind in (3, 4):
            got, above, raw = [0] * step + [0] * stride, [0] * step + up.tolist(), row.tolist()
            for i in range(stride):
                a, b, c = got[i], above[i + step], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                got[i + step] = (raw[i] + guess) & 255
            now[:] = got[step:]
        else:
            raise ValueError("no such filter")
    return out[1:]


def decode(content: bytes, most: int = 1 << 28) -> np.ndarray:
    """(height, width, 4) of a PNG that isn't interlaced; `most` bounds the pixels before anything is inflated."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette, clear = 8, [], None, None
    while at + 12 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            w, h, bits, color, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if lace:
        raise ValueError("interlaced files aren't read")
    if w * h > most:
        raise ValueError("more pixels than allowed")
    many = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = (w * many * bits + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(parts), h * (stride + 1))
    rows = _unfiltered(raw, h, stride, max(1, many * bits // 8))
    if bits == 16:
        wide = rows.view(">u2").astype(np.uint16).reshape(h, w, many)
    elif bits == 8:
        wide = rows.reshape(h, w, many).astype(np.uint16)
    else:
        single = np.unpackbits(rows, axis=1).reshape(h, -1, bits)[:, :w]
        wide = (single @ (1 << np.arange(bits)[::-1])).astype(np.uint16)[..., None]
    out = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        out[..., :3] = palette[wide[..., 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[wide[..., 0]]
        return out
    byte = (wide >> 8 if bits == 16 else wide * (255 // ((1 << bits) - 1))).astype(np.uint8)
    out[..., :3] = byte[..., :3] if color in (2, 6) else byte[..., :1]
    if color in (4, 6):
        out[..., 3] = byte[..., -1]
    elif clear is not None:
        out[..., 3] = np.where((wide == np.frombuffer(clear, ">u2")[:many]).all(axis=2), 0, 255)
    return out
