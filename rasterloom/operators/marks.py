"""Hidden marks on packed images: least significant bits of opaque pixels, and signs of two coefficients of 8 x 8 blocks.

A frame is a magic, a byte that says whether a key was used, the payload's length, the payload, and a check: CRC-32, or with a key the
first bytes of an HMAC-SHA-256. With a key, the places are a walk that the key seeds. One image is one task's work; nothing is shuffled.
An image too small for its mark stays as it is, and says so in `error`.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import hmac
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.functions.color import ParameterError, within
from rasterloom.operators.packed import PACKED, _rasters

#: Magics, bytes of a keyed check, payload bytes at most.
LSB, DCT = (b"DMLS", 16, 4096), (b"DD", 8, 24)
#: Bits of a block mark's frame, and how often each bit stands, at least and at most.
FRAME_BITS, FEWEST, MOST = 304, 3, 15
#: Seeds the places of block marks without a key; marks of other writers need theirs.
PUBLIC = b"rasterloom block layout"
READING = "image_id long, status string, payload binary"


def derived(key: bytes, context: str, data: bytes = b"") -> bytes:
    """A key for one purpose."""
    return hmac.new(key, context.encode() + b"\0" + data, hashlib.sha256).digest()


class Walk:
    """xoshiro256** from 32 bytes, with numbers under a bound drawn without bias."""

    def __init__(self, seed: bytes) -> None:
        self.state = [int.from_bytes(seed[k : k + 8], "little") for k in range(0, 32, 8)]

    def draw(self) -> int:
        a, b, c, d = self.state
        whole = (1 << 64) - 1
        turn = lambda v, k: (v << k | v >> 64 - k) & whole
        out = turn(b * 5 & whole, 7) * 9 & whole
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ (b << 17 & whole), turn(d, 45)]
        return out

    def below(self, n: int) -> int:
        """0 to n - 1, from the low 32 bits of draws, or all 64 where n needs them."""
        bits = 32 if n <= 1 << 32 else 64
        whole = 1 << bits
        fair = whole - whole % n
        while (got := self.draw() & whole - 1) >= fair:
            pass
        return got % n

    def shuffled(self, n: int) -> np.ndarray:
        out = np.arange(n)
        for last in range(n - 1, 0, -1):
            other = self.below(last + 1)
            out[last], out[other] = out[other], out[last]
        return out


@functools.lru_cache(64)
def _order(seed: bytes, many: int) -> np.ndarray:
    return Walk(seed).shuffled(many)


def framed(payload: bytes, kind: tuple, key: bytes | None) -> bytes:
    head = kind[0] + bytes([key is not None]) + len(payload).to_bytes(2, "big") + payload
    return head + check(head, kind, key)


def check(head: bytes, kind: tuple, key: bytes | None) -> bytes:
    return zlib.crc32(head).to_bytes(4, "big") if key is None else derived(key, "check " + kind[0].hex(), head)[: kind[1]]


def reading(data: Callable[[int, int], bytes], room: int, kind: tuple, key: bytes | None) -> tuple[str, bytes | None]:
    """absent, or intact, authentic or tampered with the payload; data(at, n) gives bytes of the frame, room how many there are."""
    magic, keyed, most = kind
    n = len(magic) + 3
    if room < n:
        return "absent", None
    head = data(0, n)
    length, tail = int.from_bytes(head[-2:], "big"), 4 if key is None else keyed
    if head[: len(magic)] != magic or not 1 <= length <= most or n + length + tail > room or bool(head[len(magic)] & 1) != (key is not None):
        return "absent", None
    body = data(0, n + length + tail)
    good = hmac.compare_digest(check(body[:-tail], kind, key), body[-tail:])
    return ("tampered" if not good else "intact" if key is None else "authentic"), body[n:-tail]


def _bits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))


class Slots:
    """Places of channel bytes in the order of embedding."""

    def __init__(self, raster: np.ndarray, key: bytes | None) -> None:
        opaque = (raster[..., 3] == 255).ravel()
        self.open, self.key = opaque, key
        self.capacity = int(opaque.sum()) * 3 // (1 if key is None else 2)  # a walk keeps half in reserve
        self.walk, self.used, self.found = None if key is None else Walk(derived(key, "lsb-walk")), set(), []

    def first(self, n: int) -> np.ndarray:
        if self.walk is None:
            pixels = np.flatnonzero(self.open)[: -(-n // 3)]
            return (pixels[:, None] * 4 + np.arange(3)).ravel()[:n]
        while len(self.found) < n:
            slot = self.walk.below(len(self.open) * 3)
            if slot not in self.used and self.open[slot // 3]:
                self.used.add(slot)
                self.found.append(slot // 3 * 4 + slot % 3)
        return np.array(self.found[:n], np.int64)


@dataclasses.dataclass(frozen=True)
class LsbMark:
    """A mark in the lowest bits of red, green and blue of opaque pixels; only lossless files keep it."""

    key: bytes | None = None
    kind = LSB

    def room(self, raster: np.ndarray) -> int:
        return Slots(raster, self.key).capacity

    def embed(self, raster: np.ndarray, payload: bytes) -> np.ndarray:
        bits, slots = _bits(framed(payload, LSB, self.key)), Slots(raster, self.key)
        if slots.capacity < len(bits):
            raise ParameterError(f"{len(bits)} bits don't fit in {slots.capacity}")
        flat = raster.copy().reshape(-1)
        at = slots.first(len(bits))
        flat[at] = flat[at] & 0xFE | bits
        return flat.reshape(raster.shape)

    def read(self, raster: np.ndarray) -> tuple[str, bytes | None]:
        slots, flat = Slots(raster, self.key), raster.reshape(-1)
        return reading(lambda at, n: np.packbits(flat[slots.first((at + n) * 8)[at * 8 :]] & 1).tobytes(), slots.capacity // 8, LSB, self.key)


def _wave(u: int, v: int) -> np.ndarray:
    side = lambda k: np.cos((2 * np.arange(8) + 1) * k * np.pi / 16)
    return 0.25 * np.outer(side(v), side(u))


@dataclasses.dataclass(frozen=True)
class DctMark:
    """A mark of 24 bytes at most that outlives compression: in each block the sign of the difference of two middle frequencies is a bit."""

    key: bytes | None = None
    strength: float = 24.0
    public: bytes = PUBLIC
    kind = DCT

    def __post_init__(self) -> None:
        within("strength", self.strength, 4, 100)

    def _blocks(self, raster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the blocks that carry bits; block i carries bit i mod FRAME_BITS."""
        across = raster.shape[1] // 8
        many = across * (raster.shape[0] // 8)
        times = min(MOST, many // FRAME_BITS)
        if times < FEWEST:
            raise ParameterError(f"{FEWEST * FRAME_BITS} blocks don't fit in {many}")
        seed = hashlib.sha256(self.public).digest() if self.key is None else derived(self.key, "dct-layout")
        order = _order(seed, many)[: times * FRAME_BITS]
        return order // across, order % across

    @staticmethod
    def _tiles(raster: np.ndarray) -> np.ndarray:
        down, across = raster.shape[0] // 8, raster.shape[1] // 8
        return raster[: down * 8, : across * 8, :3].reshape(down, 8, across, 8, 3).swapaxes(1, 2)

    def _gaps(self, tiles: np.ndarray) -> np.ndarray:
        light = tiles.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
        return (light * _wave(2, 1)).sum(axis=(-2, -1)) - (light * _wave(1, 2)).sum(axis=(-2, -1))

    def embed(self, raster: np.ndarray, payload: bytes) -> np.ndarray:
        rows, cols = self._blocks(raster)
        bits = _bits(framed(payload, DCT, self.key).ljust(FRAME_BITS // 8, b"\0"))
        sign = np.where(np.resize(bits, len(rows)) == 1, 1.0, -1.0)
        out = raster.copy()
        tiles = self._tiles(raster)[rows, cols]
        missing = np.maximum(0, self.strength - sign * self._gaps(tiles))
        change = (sign * missing / 2)[:, None, None] * (_wave(2, 1) - _wave(1, 2))
        moved = tiles + change[..., None]
        moved = np.clip(np.sign(moved) * np.floor(np.abs(moved) + 0.5), 0, 255).astype(np.uint8)
        self._tiles(out)[rows, cols] = moved
        return out

    def read(self, raster: np.ndarray) -> tuple[str, bytes | None]:
        try:
            rows, cols = self._blocks(raster)
        except ParameterError:
            return "absent", None
        votes = np.where(self._gaps(self._tiles(raster)[rows, cols]) > 0, 1, -1).reshape(-1, FRAME_BITS).sum(axis=0)
        whole = np.packbits(votes > 0).tobytes()
        return reading(lambda at, n: whole[at : at + n], len(whole), DCT, self.key)


def embed(packed: DataFrame, mark: LsbMark | DctMark, payload: bytes | str) -> DataFrame:
    """Marked images and error. payload: bytes for all images, or the name of a binary column with one for each."""
    if isinstance(payload, bytes):
        _fits(payload, mark)
    columns = ["image_id", "width", "height", "data", *([payload] if isinstance(payload, str) else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (image_id, raster) in enumerate(_rasters(batch)):
                error = None
                try:
                    own = payload if isinstance(payload, bytes) else batch.column(4)[k].as_py()
                    raster = mark.embed(raster, _fits(own, mark))
                except ParameterError as e:
                    error = str(e)
                h, w, _ = raster.shape
                yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([raster.tobytes()], pa.binary()), pa.array([error], pa.string())], ["image_id", "width", "height", "data", "error"])

    return packed.select(*columns).mapInArrow(run, PACKED + ", error string")


def _fits(payload: bytes | None, mark: LsbMark | DctMark) -> bytes:
    if not payload or len(payload) > mark.kind[2]:
        raise ParameterError(f"a payload has 1 to {mark.kind[2]} bytes")
    return payload


def read(packed: DataFrame, mark: LsbMark | DctMark) -> DataFrame:
    """image_id, status and payload of each image: absent, intact (no key), authentic (the key's check holds) or tampered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(image_id, *mark.read(raster)) for image_id, raster in _rasters(batch)]
            ids, status, payload = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(status, pa.string()), pa.array(payload, pa.binary())], ["image_id", "status", "payload"])

    return packed.select("image_id", "width", "height", "data").mapInArrow(run, READING)
