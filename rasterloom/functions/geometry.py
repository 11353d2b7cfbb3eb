"""Sizes, rectangles, anchors and positions, as plain numbers on the driver and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.color import ParameterError, within

# Horizontal and vertical halves of the nine anchors.
ANCHORS = {"top-left": (0, 0), "top": (1, 0), "top-right": (2, 0), "left": (0, 1), "center": (1, 1), "right": (2, 1), "bottom-left": (0, 2), "bottom": (1, 2), "bottom-right": (2, 2)}
#: EXIF orientation -> (quarter turns clockwise, then mirrored left to right).
ORIENTATIONS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (1, False), 7: (3, True), 8: (3, False)}


def half_up(value: float) -> int:
    return math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1)


def anchored(anchor: str, width: Column, height: Column, item_width: Column, item_height: Column) -> tuple[Column, Column]:
    """Left and top of an item; halves are cut towards zero, also below zero."""
    if anchor not in ANCHORS:
        raise ParameterError(f"unknown anchor {anchor}")
    across, down = ANCHORS[anchor]
    cut = lambda v, k: (F.sign(v) * F.floor(F.abs(v) * k / 2)).cast("int")
    return cut(width - item_width, across), cut(height - item_height, down)


def inset(anchor: str, margin: int, width: Column, height: Column, item_width: Column, item_height: Column) -> tuple[Column, Column]:
    """An anchored place moved inwards by a margin from the sides that the anchor touches."""
    left, top = anchored(anchor, width, height, item_width, item_height)
    across, down = ANCHORS[anchor]
    return left + F.lit(margin * (1 - across)), top + F.lit(margin * (1 - down))


def at_least_one(value: Column) -> Column:
    return F.greatest(F.lit(1), F.round(value).cast("int"))


def scaled(width: Column, height: Column, factor: float) -> tuple[Column, Column]:
    if not math.isfinite(factor) or factor <= 0:
        raise ParameterError("factor must be over 0")
    return at_least_one(width * F.lit(float(factor))), at_least_one(height * F.lit(float(factor)))


def scaled_to_width(width: Column, height: Column, target: int) -> tuple[Column, Column]:
    return F.lit(target), at_least_one(F.lit(float(target)) / (width / height.cast("double")))


def scaled_to_height(width: Column, height: Column, target: int) -> tuple[Column, Column]:
    return at_least_one(F.lit(float(target)) * (width / height.cast("double"))), F.lit(target)


def _by(width: Column, height: Column, factor: Column) -> tuple[Column, Column]:
    return at_least_one(width * factor), at_least_one(height * factor)


def fit_inside(width: Column, height: Column, box: tuple[int, int], upscale: bool = False) -> tuple[Column, Column]:
    """The largest size of the same shape inside a box; an image that the box holds stays, unless it may grow."""
    factor = F.least(F.lit(float(box[0])) / width, F.lit(float(box[1])) / height)
    w, h = _by(width, height, factor)
    if upscale:
        return w, h
    holds = (width <= box[0]) & (height <= box[1])
    return F.when(holds, width).otherwise(w).cast("int"), F.when(holds, height).otherwise(h).cast("int")


def fit_outside(width: Column, height: Column, box: tuple[int, int], upscale: bool = False) -> tuple[Column, Column]:
    """The smallest size of the same shape that covers a box; without upscaling, a result of more pixels than the image has is refused."""
    factor = F.greatest(F.lit(float(box[0])) / width, F.lit(float(box[1])) / height)
    w, h = _by(width, height, factor)
    if upscale:
        return w, h
    grows = w.cast("long") * h > width.cast("long") * height
    return F.when(grows, width).otherwise(w).cast("int"), F.when(grows, height).otherwise(h).cast("int")


def rotated(width: Column, height: Column, degrees: float) -> tuple[Column, Column]:
    """Size of the box around an image that is turned."""
    angle = normalized(degrees)
    if angle % 90 == 0:
        return (width, height) if angle % 180 == 0 else (height, width)
    s, c = abs(math.sin(math.radians(angle))), abs(math.cos(math.radians(angle)))
    return at_least_one(width * F.lit(c) + height * F.lit(s)), at_least_one(width * F.lit(s) + height * F.lit(c))


def normalized(degrees: float) -> float:
    """An angle within [0, 360); what rounds up to 360 is 0."""
    if not math.isfinite(degrees):
        raise ParameterError("an angle must be finite")
    out = math.fmod(degrees, 360)
    out = out + 360 if out < 0 else out
    return 0.0 if out >= 360 else out + 0.0


def intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """left, top, width, height of the overlap of two half-open rectangles; null where they only touch or are apart."""
    left, top = F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"])
    w = F.least(a["left"] + a["w"], b["left"] + b["w"]) - left
    h = F.least(a["top"] + a["h"], b["top"] + b["h"]) - top
    some = (w > 0) & (h > 0)
    return {"left": F.when(some, left), "top": F.when(some, top), "w": F.when(some, w), "h": F.when(some, h)}


def contains(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    return (inner["left"] >= outer["left"]) & (inner["top"] >= outer["top"]) & (inner["left"] + inner["w"] <= outer["left"] + outer["w"]) & (inner["top"] + inner["h"] <= outer["top"] + outer["h"])


def memory_estimate(frames: Column, width: Column, height: Column) -> Column:
    """Bytes that decoding takes: each frame, and two more, at four bytes a pixel."""
    return (frames + 2).cast("long") * width.cast("long") * height.cast("long") * 4


#: The order in which limits are checked.
LIMITS = ("input_bytes", "width", "height", "pixels", "frames", "animation_pixels", "memory")


def violation(values: dict[str, Column], limits: dict[str, int]) -> Column:
    """The first limit that is exceeded, as struct(type, actual, allowed); null where all hold."""
    for name, most in limits.items():
        if name not in LIMITS:
            raise ParameterError(f"unknown limit {name}")
        within(name, most, 1, 2**62)
    out = F.lit(None).cast("struct<type:string,actual:long,allowed:long>")
    for name in reversed(LIMITS):
        if name in limits:
            hit = F.struct(F.lit(name).alias("type"), values[name].cast("long").alias("actual"), F.lit(limits[name]).cast("long").alias("allowed"))
            out = F.when(values[name] > limits[name], hit).otherwise(out)
    return out
