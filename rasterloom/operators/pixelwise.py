"""Operations on the pixels relation (image_id, x, y, r, g, b, a): projections, filters, coordinate remaps and joins.

All stay in Catalyst: pointwise chains fuse into one stage, remaps are projections, and only pad, composite and mask join. The
second input of a join is broadcast only where its size is checked; otherwise it is an equi-join on coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color, geometry
from rasterloom.functions.color import Channels, ParameterError

#: A joined image of up to so many pixels is broadcast (20 bytes a pixel).
BROADCAST_PIXELS = 1 << 18


def apply(pixels: DataFrame, change: Callable[[Channels], Channels | list[Channels]]) -> DataFrame:
    """Puts new channels in the place of old ones; change comes from functions.color, as one level or several that build on each other."""
    return levels(pixels, change(color.channels()))


def levels(pixels: DataFrame, change: Channels | list[Channels]) -> DataFrame:
    """Adds columns level by level, so that a value which many expressions name is worked out once; new helper columns are dropped."""
    steps = change if isinstance(change, list) else [change]
    out = pixels
    for step in steps:
        out = out.withColumns(step)
    return out.drop(*{n for step in steps[:-1] for n in step} - set(pixels.columns)) if len(steps) > 1 else out


def sized(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """pixels with width and height of their image, from sizes(image_id, width, height) or from the pixels themselves."""
    sizes = sizes if sizes is not None else pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return pixels.drop("width", "height").join(sizes.select("image_id", "width", "height"), "image_id")


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    if min(left, top) < 0 or min(width, height) < 1:
        raise ParameterError("a crop starts in the image and has an area")
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return pixels.filter(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def crop_anchored(pixels: DataFrame, width: int, height: int, anchor: str = "center") -> DataFrame:
    """Cuts each image to a size, clamped to the image; needs width and height columns."""
    w, h = F.least(F.lit(width), F.col("width")), F.least(F.lit(height), F.col("height"))
    left, top = geometry.anchored(anchor, F.col("width"), F.col("height"), w, h)
    moved = pixels.withColumns({"_l": left, "_t": top, "_w": w, "_h": h})
    inside = (F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_l") + F.col("_w")) & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_t") + F.col("_h"))
    return moved.filter(inside).withColumns({"x": F.col("x") - F.col("_l"), "y": F.col("y") - F.col("_t"), "width": F.col("_w"), "height": F.col("_h")}).drop("_l", "_t", "_w", "_h")


def trim_bounds(pixels: DataFrame) -> DataFrame:
    """The box of pixels that differ from the pixel at (0, 0); a uniform image keeps that one pixel."""
    corner = F.min_by(F.struct("r", "g", "b", "a"), F.struct("y", "x"))
    border = pixels.groupBy("image_id").agg(corner.alias("_border"))
    own = F.struct("r", "g", "b", "a") != F.col("_border")
    box = pixels.join(border, "image_id").groupBy("image_id").agg(*(f(F.when(own, c)).alias(n) for f, c, n in ((F.min, F.col("x"), "l"), (F.min, F.col("y"), "t"), (F.max, F.col("x"), "r"), (F.max, F.col("y"), "b"))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return box.select("image_id", zero(F.col("l")).alias("left"), zero(F.col("t")).alias("top"), (zero(F.col("r") - F.col("l")) + 1).alias("width"), (zero(F.col("b") - F.col("t")) + 1).alias("height"))


def trim(pixels: DataFrame) -> DataFrame:
    box = trim_bounds(pixels).select("image_id", F.col("left").alias("_l"), F.col("top").alias("_t"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    inside = (F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_l") + F.col("_w")) & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_t") + F.col("_h"))
    return pixels.join(box, "image_id").filter(inside).withColumns({"x": F.col("x") - F.col("_l"), "y": F.col("y") - F.col("_t")}).drop("_l", "_t", "_w", "_h")


def flip(pixels: DataFrame, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    """Mirrors; needs width and height columns."""
    x = F.col("width") - 1 - F.col("x") if horizontal else F.col("x")
    y = F.col("height") - 1 - F.col("y") if vertical else F.col("y")
    return pixels.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def rotate(pixels: DataFrame, degrees: int) -> DataFrame:
    """Turns clockwise by a multiple of 90; needs width and height columns. Other angles are in operators.packed."""
    turns = (int(geometry.normalized(degrees)) // 90) % 4
    if degrees % 90:
        raise ParameterError("pixel rows turn by multiples of 90 degrees")
    w, h, x, y = (F.col(c) for c in ("width", "height", "x", "y"))
    moved = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns]
    size = (w, h) if turns % 2 == 0 else (h, w)
    return pixels.withColumns({"x": moved[0].cast("int"), "y": moved[1].cast("int"), "width": size[0], "height": size[1]})


def auto_orient(pixels: DataFrame) -> DataFrame:
    """Turns and mirrors each image by its own orientation column (1..8, anything else is 1), which becomes 1."""
    o, w, h, x, y = (F.col(c) for c in ("orientation", "width", "height", "x", "y"))
    nx, ny = x, y
    for k, (turns, mirror) in geometry.ORIENTATIONS.items():
        px, py = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns]
        side = w if turns % 2 == 0 else h
        nx, ny = F.when(o == k, side - 1 - px if mirror else px).otherwise(nx), F.when(o == k, py).otherwise(ny)
    swap = o.between(5, 8)
    return pixels.withColumns({"x": nx.cast("int"), "y": ny.cast("int"), "width": F.when(swap, h).otherwise(w), "height": F.when(swap, w).otherwise(h), "orientation": F.lit(1)})


def resize_nearest(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest neighbour to a fixed size: each source pixel goes to the range of targets that it is nearest to; no join."""
    if min(width, height) < 1:
        raise ParameterError("a size is at least 1 x 1")
    first = lambda p, n, m: F.ceil(p * F.lit(float(m)) / n).cast("int")
    targets = lambda p, n, m: F.when(first(p, n, m) <= first(p + 1, n, m) - 1, F.sequence(first(p, n, m), first(p + 1, n, m) - 1)).otherwise(F.array().cast("array<int>"))
    rows = pixels.withColumn("_x", F.explode(targets(F.col("x"), F.col("width"), width))).withColumn("_y", F.explode(targets(F.col("y"), F.col("height"), height)))
    return rows.withColumns({"x": F.col("_x"), "y": F.col("_y"), "width": F.lit(width), "height": F.lit(height)}).drop("_x", "_y")


def blank(spark, image_id: int, width: int, height: int, rgba: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """A filled image, transparent by default."""
    area = spark.range(width * height)
    return area.select(F.lit(image_id).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), *(F.lit(v).alias(n) for n, v in zip("rgba", rgba, strict=True)))


def pad(pixels: DataFrame, left: int, top: int, right: int, bottom: int, rgba: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Grows the canvas; needs width and height columns. The frame is generated from one row for each image, so nothing joins."""
    if min(left, top, right, bottom) < 0:
        raise ParameterError("padding is at least 0")
    moved = pixels.withColumns({"x": F.col("x") + left, "y": F.col("y") + top, "width": F.col("width") + left + right, "height": F.col("height") + top + bottom})
    corner = pixels.filter("x = 0 AND y = 0").withColumns({"_w": F.col("width") + left + right, "_h": F.col("height") + top + bottom})
    frame = corner.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
    outside = (F.col("_x") < left) | (F.col("_x") >= F.col("_w") - right) | (F.col("_y") < top) | (F.col("_y") >= F.col("_h") - bottom)
    frame = frame.filter(outside).withColumns({"x": F.col("_x"), "y": F.col("_y"), "width": F.col("_w"), "height": F.col("_h")} | {n: F.lit(v) for n, v in zip("rgba", rgba, strict=True)})
    return moved.unionByName(frame.select(moved.columns))


def rounded_corners(pixels: DataFrame, radius: int) -> DataFrame:
    """Clears the alpha outside corner circles; needs width and height columns. The radius is at most half of the shorter side."""
    if radius < 0:
        raise ParameterError("a radius is at least 0")
    w, h, x, y = (F.col(c).cast("double") for c in ("width", "height", "x", "y"))
    r = F.least(F.lit(float(radius)), F.floor(F.least(w, h) / 2))
    dx = F.when(x < r, r - 0.5 - x).when(x >= w - r, x - (w - r - 0.5)).otherwise(0.0)
    dy = F.when(y < r, r - 0.5 - y).when(y >= h - r, y - (h - r - 0.5)).otherwise(0.0)
    corner = ((x < r) | (x >= w - r)) & ((y < r) | (y >= h - r))
    return pixels.withColumn("a", F.when(corner & (dx * dx + dy * dy >= r * r), 0).otherwise(F.col("a")))


def _second(image: DataFrame) -> DataFrame:
    return F.broadcast(image) if image.limit(BROADCAST_PIXELS + 1).count() <= BROADCAST_PIXELS else image


def mask(pixels: DataFrame, image: DataFrame) -> DataFrame:
    """Multiplies alpha by the alpha of one mask image (x, y, a) of the same size."""
    other = _second(image.select("x", "y", F.col("a").alias("_a")))
    return pixels.join(other, ["x", "y"]).withColumn("a", color.to_byte(F.col("a") * F.col("_a") / F.lit(255.0))).drop("_a")


def composite(pixels: DataFrame, overlay: DataFrame, left: int = 0, top: int = 0, mode: str = "normal", opacity: float = 1.0) -> DataFrame:
    """Lays one image (x, y, r, g, b, a) over each image at a place; what hangs over is clipped."""
    over = overlay.select((F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), *(F.col(n).alias(f"_{n}") for n in "rgba"))
    joined = pixels.join(_second(over), ["x", "y"], "left")
    return levels(joined, color.source_over(color.channels(), {n: F.col(f"_{n}") for n in "rgba"}, mode, opacity)).drop("_r", "_g", "_b", "_a")


def draw(pixels: DataFrame, shapes: list[tuple[Column, tuple[int, int, int, int]]]) -> DataFrame:
    """Fills shapes, given as predicates over x and y with a color, in order, source-over."""
    for inside, rgba in shapes:
        ink = {n: F.when(inside, F.lit(v)) for n, v in zip("rgba", rgba, strict=True)}
        pixels = levels(pixels, color.source_over(color.channels(), ink))
    return pixels


def rectangle(left: int, top: int, width: int, height: int) -> Column:
    return F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)


def ellipse(cx: float, cy: float, width: float, height: float) -> Column:
    return F.pow((F.col("x") - cx) * 2.0 / width, F.lit(2)) + F.pow((F.col("y") - cy) * 2.0 / height, F.lit(2)) <= 1.0


def polygon(points: list[tuple[float, float]]) -> Column:
    """Even-odd rule over 3 to 10,000 points."""
    if not 3 <= len(points) <= 10_000:
        raise ParameterError("a polygon has 3 to 10,000 points")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(min(y1, y2)) <= F.col("y")) & (F.col("y") < F.lit(max(y1, y2)))
            at = F.lit(float(x1)) + (F.col("y") - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(spans & (F.col("x") < at), 1).otherwise(0)
    return crossings % 2 == 1
