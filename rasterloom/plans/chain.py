"""Lists of operations on packed images, run as one pass.

A step is a kernel, a macro that makes kernels for an image's size, or a hidden mark. Hidden marks go last, in their order, since any later
change would damage them; a mark that doesn't outlive a lossy file is refused before one. All steps run in one Arrow pass without a shuffle.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.functions.color import ParameterError
from rasterloom.operators import marks
from rasterloom.operators.packed import PACKED, Kernel, _rasters

LOSSLESS = ("png",)


@dataclasses.dataclass(frozen=True)
class Macro:
    """Kernels that depend on the size of the image that comes in."""

    expand: Callable[[int, int], list[Kernel]]

    def __call__(self, raster: np.ndarray) -> np.ndarray:
        for kernel in self.expand(raster.shape[1], raster.shape[0]):
            raster = kernel(raster)
        return raster


@dataclasses.dataclass(frozen=True)
class Region:
    """A kernel on a box alone. It must keep the box's size; a box that leaves the image is refused."""

    kernel: Kernel
    left: int
    top: int
    width: int
    height: int

    def __call__(self, raster: np.ndarray) -> np.ndarray:
        h, w, _ = raster.shape
        if min(self.left, self.top) < 0 or min(self.width, self.height) < 1 or self.left + self.width > w or self.top + self.height > h:
            raise ParameterError("a box leaves the image")
        box = (slice(self.top, self.top + self.height), slice(self.left, self.left + self.width))
        new = self.kernel(raster[box].copy())
        if new.shape != raster[box].shape:
            raise ParameterError("an operation on pixels keeps their number")
        out = raster.copy()
        out[box] = new
        return out


@dataclasses.dataclass(frozen=True)
class Marked:
    """A hidden mark with its payload."""

    mark: marks.LsbMark | marks.DctMark
    payload: bytes

    def __post_init__(self) -> None:
        marks._fits(self.payload, self.mark)

    def __call__(self, raster: np.ndarray) -> np.ndarray:
        return self.mark.embed(raster, self.payload)


Step = Kernel | Macro | Region | Marked


def ordered(steps: list[Step]) -> list[Step]:
    """Steps in their order, hidden marks after all others."""
    return sorted(steps, key=lambda s: isinstance(s, Marked))


def run(packed: DataFrame, *steps: Step, output: str | None = None, most_pixels: int = 50_000_000) -> DataFrame:
    """Images after all steps, and error: an image that a step refuses, or that grows over most_pixels, has null data and the reason.

    output names the format that the images are to be written in: marks that it would wipe out are refused here.
    """
    if output is not None and output not in LOSSLESS and any(isinstance(s, Marked) and isinstance(s.mark, marks.LsbMark) for s in steps):
        raise ParameterError(f"{output} files lose the lowest bits")
    plan = ordered(list(steps))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, raster in _rasters(batch):
                error = None
                try:
                    for step in plan:
                        raster = step(raster)
                        if raster.shape[0] * raster.shape[1] > most_pixels:
                            raise ParameterError("more pixels than allowed")
                except ParameterError as e:
                    raster, error = None, str(e)
                size = (None, None) if raster is None else (raster.shape[1], raster.shape[0])
                yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.int64()), *(pa.array([v], pa.int32()) for v in size), pa.array([None if raster is None else np.ascontiguousarray(raster).tobytes()], pa.binary()), pa.array([error], pa.string())], ["image_id", "width", "height", "data", "error"])

    return packed.select("image_id", "width", "height", "data").mapInArrow(work, PACKED + ", error string")
