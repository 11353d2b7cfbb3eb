"""The packed layout: one row an image, (image_id, width, height, data) with data as RGBA bytes row by row.

Neighbourhood operators run here, several in one pass over Arrow batches. Each is a function from a (height, width, 4) raster to another.
Where colors of several pixels are mixed in a resampling, they are weighed by alpha.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import ParameterError, within
from rasterloom.functions.geometry import ANCHORS, half_up
from rasterloom.sources import png

Kernel = Callable[[np.ndarray], np.ndarray]
PACKED = "image_id long, width int, height int, data binary"


def pack(pixels: DataFrame) -> DataFrame:
    """Pixels as packed images. An image is one group; limits bound its size before."""
    value = F.col("r").cast("long") * (1 << 24) + F.col("g") * (1 << 16) + F.col("b") * (1 << 8) + F.col("a")
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    rows = pixels.groupBy("image_id").agg(F.first("width").cast("int").alias("width"), F.first("height").cast("int").alias("height"), F.sort_array(F.collect_list(F.struct(place.alias("p"), value.alias("v"))))["v"].alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v.values).astype(">u4").tobytes() for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], ["image_id", "width", "height", "data"])

    return rows.select(F.col("image_id").cast("long"), "width", "height", "v").mapInArrow(run, PACKED)


def _rasters(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, w, h, data in zip(*(batch.column(k) for k in range(4)), strict=True):
        yield i.as_py(), np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 4)


def change(packed: DataFrame, *kernels: Kernel) -> DataFrame:
    """All kernels, one after another, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, raster in _rasters(batch):
                for kernel in kernels:
                    raster = kernel(raster)
                h, w, _ = raster.shape
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([image_id], pa.int64()), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "data": [np.ascontiguousarray(raster).tobytes()]})

    return packed.select("image_id", "width", "height", "data").mapInArrow(run, PACKED)


def unpack(packed: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """The pixel relation of packed images, in batches of so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, raster in _rasters(batch):
                h, w, _ = raster.shape
                flat = raster.reshape(-1, 4).astype(np.int32)
                for at in range(0, h * w, rows):
                    place = np.arange(at, min(h * w, at + rows))
                    n = len(place)
                    cols = [np.full(n, image_id), np.full(n, w, np.int32), np.full(n, h, np.int32), (place % w).astype(np.int32), (place // w).astype(np.int32), *flat[at : at + n].T]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["image_id", "width", "height", "x", "y", *"rgba"])

    return packed.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")


def to_png(packed: DataFrame, level: int = 6) -> DataFrame:
    """image_id, content, byte_count: each image as a PNG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, raster in _rasters(batch):
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([image_id], pa.int64()), "content": [png.encode(raster, level)]})

    return packed.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, content binary").withColumn("byte_count", F.length("content").cast("long"))


def from_png(files: DataFrame) -> DataFrame:
    """Packed images of (image_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, content in zip(batch.column(0), batch.column(1), strict=True):
                raster = png.decode(content.as_py())
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([image_id.as_py()], pa.int64()), "width": pa.array([raster.shape[1]], pa.int32()), "height": pa.array([raster.shape[0]], pa.int32()), "data": [raster.tobytes()]})

    return files.select("image_id", "content").mapInArrow(run, PACKED)


def _bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def _weighed(raster: np.ndarray, mix: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """mix of colors times alpha, and of alpha, divided again."""
    v = raster.astype(np.float64)
    v[..., :3] *= v[..., 3:] / 255
    v = mix(v)
    alpha = v[..., 3:]
    v[..., :3] = np.divide(v[..., :3] * 255, alpha, out=np.zeros_like(v[..., :3]), where=alpha > 0)
    return _bytes(v)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


#: name: (half width, weight by distance)
FILTERS: dict[str, tuple[float, Callable[[np.ndarray], np.ndarray]]] = {
    "bilinear": (1, lambda x: np.maximum(0, 1 - np.abs(x))),
    "bicubic": (2, _cubic),
    "lanczos": (3, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def _weights(source: int, target: int, name: str) -> np.ndarray:
    """target x source: rows that sum to 1; the filter is as wide as a target pixel when an image shrinks."""
    reach = max(1.0, source / target)
    if name == "nearest":
        return np.eye(source)[np.arange(target) * source // target]
    centres = (np.arange(target) + 0.5) * source / target - 0.5
    w = FILTERS[name][1]((np.arange(source)[None, :] - centres[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(width: int, height: int, name: str = "lanczos") -> Kernel:
    """To an exact size by a separable filter: nearest, bilinear, bicubic or lanczos."""
    if min(width, height) < 1:
        raise ParameterError("a size is at least 1 x 1")
    if name != "nearest" and name not in FILTERS:
        raise ParameterError(f"no filter {name}")

    def run(raster: np.ndarray) -> np.ndarray:
        h, w, _ = raster.shape
        if (h, w) == (height, width):
            return raster
        wy, wx = _weights(h, height, name), _weights(w, width, name)
        return _weighed(raster, lambda v: np.clip(np.einsum("ty,yxc,ux->tuc", wy, v, wx, optimize=True), 0, 255))

    return run


def thumbnail(width: int, height: int, anchor: str = "center", upscale: bool = True, name: str = "lanczos") -> Kernel:
    """Covers a box in the image's own shape, then cuts the box out at an anchor. Without upscaling, an image that would grow keeps its size,
    and one that then doesn't hold the box is refused."""
    if anchor not in ANCHORS:
        raise ParameterError(f"unknown anchor {anchor}")
    resize(width, height, name)  # the same parameters are refused
    across, down = ANCHORS[anchor]

    def run(raster: np.ndarray) -> np.ndarray:
        h, w, _ = raster.shape
        factor = max(width / w, height / h)
        nw, nh = max(1, half_up(w * factor)), max(1, half_up(h * factor))
        if upscale or nw * nh <= w * h:
            raster = resize(nw, nh, name)(raster)
        h, w, _ = raster.shape
        if width > w or height > h:
            raise ParameterError(f"a box of {width} x {height} leaves an image of {w} x {h}")
        left, top = (w - width) * across // 2, (h - height) * down // 2
        return raster[top : top + height, left : left + width]

    return run


def pixelate(size: int) -> Kernel:
    """Each block of size x size pixels as its mean; alpha too. Blocks at the right and bottom edge are cut."""
    within("block size", size, 1, 1 << 20)

    def run(raster: np.ndarray) -> np.ndarray:
        h, w, _ = raster.shape
        ys, xs = np.arange(0, h, size), np.arange(0, w, size)
        sums = np.add.reduceat(np.add.reduceat(raster.astype(np.int64), ys, axis=0), xs, axis=1)
        tall, wide = np.diff([*ys, h]), np.diff([*xs, w])
        means = _bytes(sums / (tall[:, None] * wide[None, :])[..., None])
        return np.repeat(np.repeat(means, tall, axis=0), wide, axis=1)

    return run


def _along(v: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """One-dimensional convolution; pixels past an edge are as the edge."""
    k, n = len(kernel) // 2, v.shape[axis]
    pad = [(0, 0)] * v.ndim
    pad[axis] = (k, k)
    wide = np.pad(v, pad, mode="edge")
    return sum(weight * np.take(wide, np.arange(i, i + n), axis=axis) for i, weight in enumerate(kernel))


def blur(sigma: float) -> Kernel:
    """A separable Gaussian over all four channels, three sigmas each way."""
    within("sigma", sigma, 0.1, 50)
    k = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    return lambda raster: _weighed(raster, lambda v: _along(_along(v, kernel, 0), kernel, 1))


def sharpen(amount: float = 1.0) -> Kernel:
    """Colors plus amount times their distance from the 3 x 3 mean of weights 1 2 1; alpha stays."""
    within("amount", amount, 0.01, 5)
    kernel = np.array([0.25, 0.5, 0.25])

    def run(raster: np.ndarray) -> np.ndarray:
        v = raster[..., :3].astype(np.float64)
        out = raster.copy()
        out[..., :3] = _bytes(v + amount * (v - _along(_along(v, kernel, 0), kernel, 1)))
        return out

    return run


def rotate(degrees: float, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Kernel:
    """Clockwise about the centre onto the bounding box; each target pixel is mixed of the four source pixels about its origin."""
    angle = math.radians(degrees % 360)
    cos, sin = math.cos(angle), math.sin(angle)

    def run(raster: np.ndarray) -> np.ndarray:
        h, w, _ = raster.shape
        nw, nh = max(1, half_up(abs(w * cos) + abs(h * sin))), max(1, half_up(abs(w * sin) + abs(h * cos)))
        framed = np.empty((h + 2, w + 2, 4), np.float64)
        framed[:] = background
        framed[1:-1, 1:-1] = raster
        framed[..., :3] *= framed[..., 3:] / 255
        dy, dx = np.mgrid[0:nh, 0:nw]
        dx, dy = dx - (nw - 1) / 2, dy - (nh - 1) / 2
        sx = np.clip(cos * dx + sin * dy + (w - 1) / 2 + 1, 0, w + 1)
        sy = np.clip(cos * dy - sin * dx + (h - 1) / 2 + 1, 0, h + 1)
        x0, y0 = np.minimum(sx.astype(int), w), np.minimum(sy.astype(int), h)
        fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
        v = (framed[y0, x0] * (1 - fx) + framed[y0, x0 + 1] * fx) * (1 - fy) + (framed[y0 + 1, x0] * (1 - fx) + framed[y0 + 1, x0 + 1] * fx) * fy
        v[..., :3] = np.divide(v[..., :3] * 255, v[..., 3:], out=np.zeros_like(v[..., :3]), where=v[..., 3:] > 0)
        return _bytes(v)

    return run
