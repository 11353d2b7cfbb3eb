"""GIF files: the container's frames, LZW codes, canvases under all disposals, and files of full frames."""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator

import numpy as np

from rasterloom.sources.headers import MOST, Broken, _u

#: Applications whose block says how often an animation plays.
LOOPS = (b"NETSCAPE2.0", b"ANIMEXTS1.0")
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


@dataclasses.dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    laced: bool
    colors: bytes | None
    clear: int | None
    disposal: int
    delay: int
    size: int
    codes: bytes


@dataclasses.dataclass
class File:
    width: int
    height: int
    colors: bytes | None
    loops: int | None
    frames: list[Frame]

    @property
    def plays(self) -> int:
        """How often it plays; 0 is forever. The file counts repeats after the first time."""
        return 1 if self.loops is None else 0 if self.loops == 0 else self.loops + 1


def _blocks(d: bytes, at: int) -> tuple[bytes, int]:
    """The data of sub-blocks, and where they end."""
    parts = []
    while n := _u(d, at, 1):
        if at + 1 + n > len(d):
            raise Broken("the file ends early")
        parts.append(d[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _table(d: bytes, at: int, flags: int) -> tuple[bytes | None, int]:
    n = 3 << (flags & 7) + 1 if flags & 128 else 0
    if at + n > len(d):
        raise Broken("the file ends early")
    return d[at : at + n] if n else None, at + n


def read(d: bytes) -> File:
    """All frames without their pixels. A missing trailer is as one; anything that is no block is an error, and so are no frames."""
    if d[:6] not in (b"GIF87a", b"GIF89a"):
        raise Broken("no signature")
    width, height = _u(d, 6, 2, "little"), _u(d, 8, 2, "little")
    colors, at = _table(d, 13, _u(d, 10, 1))
    frames, loops, control = [], None, (0, 0, 0)
    while at < len(d) and d[at] != 0x3B:
        if d[at] == 0x21:
            label, n = _u(d, at + 1, 1), _u(d, at + 2, 1)
            if label == 0xF9 and n >= 4:
                control = _u(d, at + 3, 1), _u(d, at + 4, 2, "little"), _u(d, at + 6, 1)
            elif label == 0xFF and n == 11 and d[at + 3 : at + 14] in LOOPS and _u(d, at + 14, 1) >= 3 and _u(d, at + 15, 1) == 1:
                loops = _u(d, at + 16, 2, "little")
            _, at = _blocks(d, at + 2)
        elif d[at] == 0x2C:
            x, y, w, h = (_u(d, at + k, 2, "little") for k in (1, 3, 5, 7))
            flags = _u(d, at + 9, 1)
            if min(w, h) < 1:
                raise Broken("a side of no pixels")
            own, start = _table(d, at + 10, flags)
            codes, at = _blocks(d, start + 1)
            how, delay, clear = control
            disposal = how >> 2 & 7
            frames.append(Frame(x, y, w, h, bool(flags & 64), own, clear if how & 1 else None, disposal if disposal < 4 else KEEP, delay, d[start], codes))
            control = (0, 0, 0)
        else:
            raise Broken("no such block")
    if not frames:
        raise Broken("no image")
    if not (width and height):
        width, height = max(f.left + f.width for f in frames), max(f.top + f.height for f in frames)
    return File(width, height, colors, loops, frames)


def unpacked(codes: bytes, size: int, most: int) -> np.ndarray:
    """Color numbers of LZW codes, `most` at most; what is missing at the end is 0."""
    if not 1 <= size <= 11:
        raise Broken("no such code size")
    clear, out = 1 << size, bytearray()
    first = [bytes([k & 255]) for k in range(clear)] + [b"", b""]
    words, bits, before = list(first), size + 1, None
    held, n, at = 0, 0, 0
    while len(out) < most:
        while n < bits and at < len(codes):
            held, n, at = held | codes[at] << n, n + 8, at + 1
        code = held & (1 << bits) - 1
        if n < bits or code == clear + 1:
            break
        held, n = held >> bits, n - bits
        if code == clear:
            words, bits, before = list(first), size + 1, None
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before is not None:
            word = before + before[:1]
        else:
            raise Broken("a code that can't be")
        out += word
        if before is not None and len(words) < 4096:
            words.append(before + word[:1])
            if len(words) == 1 << bits and bits < 12:
                bits += 1
        before = word
    got = np.frombuffer(bytes(out[:most]), np.uint8)
    return np.concatenate([got, np.zeros(most - len(got), np.uint8)])


def packed_codes(values: bytes, size: int) -> bytes:
    """LZW codes of color numbers."""
    clear, held, n, out = 1 << size, 0, 0, bytearray()
    words, bits = {bytes([k]): k for k in range(clear)}, size + 1

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += bits
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    word = b""
    count = clear + 2
    for k in range(len(values)):
        longer = word + values[k : k + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        if count < 4096:
            words[longer] = count
            count += 1
            if count > 1 << bits and bits < 12:
                bits += 1
        else:
            put(clear)
            words, bits, count = {bytes([j]): j for j in range(clear)}, size + 1, clear + 2
        word = values[k : k + 1]
    if word:
        put(words[word])
        # the reader makes one more word at the last code, which may widen the end code
        if count < 4096 and count + 1 > 1 << bits and bits < 12:
            bits += 1
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def raster(file: File, frame: Frame) -> np.ndarray:
    """(height, width, 4) of one frame alone; a color number past the table is black."""
    flat = unpacked(frame.codes, frame.size, frame.width * frame.height).reshape(frame.height, frame.width)
    if frame.laced:
        order = np.concatenate([np.arange(start, frame.height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
        flat = flat[np.argsort(order)]
    colors = np.zeros((256, 4), np.uint8)
    colors[:, 3] = 255
    table = np.frombuffer(frame.colors or file.colors or b"", np.uint8).reshape(-1, 3)[:256]
    colors[: len(table), :3] = table
    if frame.clear is not None:
        colors[frame.clear] = 0
    return colors[flat]


def canvases(file: File) -> Iterator[tuple[np.ndarray, int]]:
    """The full canvas and delay in ms of each frame: pixels that aren't clear are copied, then the frame's area is disposed of."""
    canvas = np.zeros((file.height, file.width, 4), np.uint8)
    for frame in file.frames:
        shown = canvas.copy()
        area = (slice(frame.top, frame.top + frame.height), slice(frame.left, frame.left + frame.width))
        under = shown[area]  # cut where the frame leaves the canvas
        over = raster(file, frame)[: under.shape[0], : under.shape[1]]
        under[over[..., 3] > 0] = over[over[..., 3] > 0]
        yield shown.copy(), frame.delay * 10
        if frame.disposal != PREVIOUS:
            canvas = shown
        if frame.disposal == BACKGROUND:
            canvas[area] = 0


def decode(d: bytes, most: int = 1 << 28) -> list[tuple[np.ndarray, int]]:
    """Canvases and delays; `most` bounds the pixels of all canvases, and of each frame, before any is unpacked."""
    file = read(d)
    sizes = [file.width * file.height * len(file.frames), *(f.width * f.height for f in file.frames)]
    if max(sizes) > most or max(file.width, file.height) > MOST:
        raise Broken("more pixels than allowed")
    return list(canvases(file))


def encode(frames: list[tuple[np.ndarray, int]], plays: int = 0) -> bytes:
    """A file of full canvases with a table of colors each. A pixel under half opacity is clear. Over 256 colors, the bits of the
    channels are cut, one at a time, until the colors fit."""
    if not frames or not 0 <= plays <= 65536:
        raise ValueError("an animation has a frame at least, and plays 0 to 65536 times")
    h, w, _ = frames[0][0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0, 0, 0)]
    if plays != 1:
        out.append(b"\x21\xff\x0b" + LOOPS[0] + b"\x03\x01" + struct.pack("<H", max(0, plays - 1)) + b"\0")
    for picture, delay in frames:
        if picture.shape != (h, w, 4):
            raise ValueError("frames have one size")
        clear = picture[..., 3] < 128
        number = picture[..., :3].astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
        cut = number
        for bits in range(8):
            keep = (255 >> bits << bits) * 0x010101
            cut = np.where(clear, -1, number & keep)
            colors, places = np.unique(cut, return_inverse=True)
            if len(colors) <= 256:
                break
        gap = bool(clear.any())
        table = np.maximum(colors, 0)
        size = max(1, int(len(colors) - 1).bit_length())
        data = np.zeros((1 << size, 3), np.uint8)
        data[: len(table)] = np.stack([table >> 16, table >> 8 & 255, table & 255], axis=1)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", BACKGROUND << 2 | gap, (delay + 5) // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 128 | size - 1) + data.tobytes())
        code_size = max(2, size)
        codes = packed_codes(places.astype(np.uint8).tobytes(), code_size)
        out.append(bytes([code_size]) + b"".join(bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)) + b"\0")
    return b"".join([*out, b"\x3b"])
