"""Aggregates and analyses of images. Averages and hashes add integers and divide last, so every plan gives the same result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import ParameterError, to_byte, to_linear

#: Integer luma: 1000 times Rec. 601.
def LUMA1000() -> Column:  # noqa: N802
    return 299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")


def average_color(pixels: DataFrame) -> DataFrame:
    """Unweighted mean of all four channels; transparent pixels count."""
    return pixels.groupBy("image_id").agg(*(F.round(F.sum(n) / F.count(F.lit(1))).cast("int").alias(n) for n in "rgba"))


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, channel, value, n for values that occur: counted by one partial aggregate over (image, channel, value)."""
    long = pixels.select("image_id", F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).alias("value")) for n in "rgba"))).alias("c"))
    return long.groupBy("image_id", "c.channel", "c.value").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(pixels: DataFrame) -> DataFrame:
    """image_id, channel and counts: an array of 256 counters."""
    pairs = histogram(pixels).groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m"))
    return pairs.select("image_id", "channel", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.element_at("m", v), F.lit(0))).alias("counts"))


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))


def pixelate(pixels: DataFrame, size: int) -> DataFrame:
    """Mean of each block, alpha too, given back to its pixels; blocks at the edges are smaller."""
    if size < 1:
        raise ParameterError("a block is at least 1 pixel")
    block = Window.partitionBy("image_id", F.floor(F.col("x") / size), F.floor(F.col("y") / size))
    return pixels.withColumns({n: to_byte(F.sum(n).over(block) / F.count(F.lit(1)).over(block)) for n in "rgba"})


def dhash(pixels: DataFrame) -> DataFrame:
    """64-bit difference hash as 16 hexadecimal digits; needs width and height columns.

    9 x 8 cells of mean luma; a bit is set if a cell is brighter than its right neighbour. Means are compared as cross products of
    integers. Images narrower than 9 or lower than 8 pixels take the cells' nearest pixels.
    """
    def cell(v: Column, n: int, side: Column) -> Column:
        last = F.ceil(n * (v + 1) / side) - 1
        return F.explode(F.sequence(F.when(side >= n, last).otherwise(F.ceil(n * v / side)), last))

    cells = pixels.select("image_id", "height", "y", LUMA1000().alias("l"), cell(F.col("x"), 9, F.col("width")).alias("gx"))
    cells = cells.select("image_id", "l", "gx", cell(F.col("y"), 8, F.col("height")).alias("gy"))
    means = cells.groupBy("image_id", "gy", "gx").agg(F.sum("l").alias("s"), F.count(F.lit(1)).alias("c"))
    row = Window.partitionBy("image_id", "gy").orderBy("gx")
    bits = means.withColumn("bit", (F.col("s") * F.lead("c").over(row) > F.lead("s").over(row) * F.col("c")).cast("int")).filter("gx < 8")
    nibble = F.sum(F.col("bit") * F.element_at(F.array(*map(F.lit, (8, 4, 2, 1))), (F.col("gx") % 4 + 1).cast("int")))
    digits = bits.groupBy("image_id", "gy", F.floor(F.col("gx") / 4).alias("half")).agg(nibble.alias("d"))
    parts = F.sort_array(F.collect_list(F.struct("gy", "half", F.lower(F.hex("d")).alias("h"))))
    return digits.groupBy("image_id").agg(F.array_join(F.transform(parts, lambda p: p["h"]), "").alias("hash"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of the same length; null for different lengths."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(a)), lambda k: F.bit_count(F.conv(F.substring(a, k, F.lit(1)), 16, 10).cast("int").bitwiseXOR(F.conv(F.substring(b, k, F.lit(1)), 16, 10).cast("int"))))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, v: s + v))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """image_id and representative, the smallest image of the same hash, of every image: with similar_pairs() all links, those at distance 0 too."""
    smallest = hashes.groupBy("hash").agg(F.min("image_id").alias("representative"))
    return hashes.join(smallest, "hash").select("image_id", "representative")


def similar_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of distinct hashes within a distance of up to 3, by four bands of 16 bits, one of which must be equal.

    Images with the same hash are one class first, so a large group of copies adds one hash to the join: a, b are classes' smallest images,
    and hash_classes() says which images each stands for.
    """
    if not 0 <= distance <= 3:
        raise ParameterError("four bands find distances up to 3")
    classes = hashes.groupBy("hash").agg(F.min("image_id").alias("image_id"))
    bands = classes.select("image_id", "hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring("hash", k * 4 + 1, F.lit(4)))).alias("k", "band"))
    a = bands.select("k", "band", F.col("image_id").alias("a"), F.col("hash").alias("ha"))
    b = bands.select("k", "band", F.col("image_id").alias("b"), F.col("hash").alias("hb"))
    return a.join(b, ["k", "band"]).filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= distance).select("a", "b", "distance").distinct()


def blurhash_components(pixels: DataFrame, nx: int = 4, ny: int = 3) -> DataFrame:
    """image_id, cx, cy and the linear-light factors r, g, b of a blurhash; needs width and height columns."""
    if not (1 <= nx <= 9 and 1 <= ny <= 9):
        raise ParameterError("1 to 9 components each way")
    basis = F.explode(F.array(*(F.struct(F.lit(i).alias("cx"), F.lit(j).alias("cy")) for j in range(ny) for i in range(nx)))).alias("c")
    rows = pixels.select("image_id", "x", "y", "width", "height", *(to_linear(F.col(n) / F.lit(255.0)).alias(n) for n in "rgb"), basis)
    wave = F.cos(F.lit(math.pi) * F.col("c.cx") * F.col("x") / F.col("width")) * F.cos(F.lit(math.pi) * F.col("c.cy") * F.col("y") / F.col("height"))
    scale = F.when((F.col("cx") == 0) & (F.col("cy") == 0), 1.0).otherwise(2.0) / F.first("area")
    rows = rows.select("image_id", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), (F.col("width") * F.col("height")).alias("area"), wave.alias("w"), "r", "g", "b")
    return rows.groupBy("image_id", "cx", "cy").agg(*((F.sum(F.col("w") * F.col(n)) * scale).alias(n) for n in "rgb"))


# The digits of base 83, in order.
BASE83 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"


def base83(value: int, length: int) -> str:
    return "".join(BASE83[value // 83 ** (length - 1 - k) % 83] for k in range(length))


def blurhash(pixels: DataFrame, nx: int = 4, ny: int = 3) -> DataFrame:
    """image_id and blurhash: components by aggregation, the short string of each image by one Arrow function."""
    parts = F.sort_array(F.collect_list(F.struct("cy", "cx", "r", "g", "b"))).alias("parts")
    rows = blurhash_components(pixels, nx, ny).groupBy("image_id").agg(parts)

    def encode(parts) -> str:
        values = np.array([[p["r"], p["g"], p["b"]] for p in parts])
        srgb = np.where(values[0] <= 0.0031308, values[0] * 12.92, np.power(np.maximum(values[0], 1e-12), 1 / 2.4) * 1.055 - 0.055)
        dc = np.clip(np.floor(srgb * 255 + 0.5), 0, 255).astype(int)
        out = base83(nx - 1 + (ny - 1) * 9, 1)
        ac = values[1:]
        top = float(np.abs(ac).max()) if len(ac) else 0.0
        level = int(min(82, max(0, math.floor(top * 166 - 0.5)))) if len(ac) else 0
        out += base83(level, 1) + base83(int(dc[0]) << 16 | int(dc[1]) << 8 | int(dc[2]), 4)
        for v in ac:
            q = np.clip(np.floor(np.sign(v) * np.sqrt(np.abs(v) * 166 / (level + 1)) * 9 + 9.5), 0, 18).astype(int)
            out += base83(int(q[0]) * 361 + int(q[1]) * 19 + int(q[2]), 2)
        return out

    @F.pandas_udf("string")
    def encoded(column):
        return column.map(encode)

    return rows.select("image_id", encoded("parts").alias("blurhash"))


def palette(pixels: DataFrame, colors: int = 5) -> DataFrame:
    """image_id, rank, r, g, b, n: a median cut over at most 8,191 evenly spaced pixels of each image, most populous first."""
    if colors < 1:
        raise ParameterError("a palette has at least one color")
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    stride = F.greatest(F.lit(1), F.floor(F.size("p") / 4096)).cast("int")
    sampled = rows.select("image_id", F.filter("p", lambda _, i: i % stride == 0).alias("p"))

    def cut(values: np.ndarray) -> list[tuple[int, int, int, int]]:
        boxes = [values]
        while len(boxes) < colors:
            best, pick = 0, None
            for k, box in enumerate(boxes):
                for c, span in enumerate(box.max(axis=0) - box.min(axis=0)):
                    if span > best:
                        best, pick = span, (k, c)
            if pick is None:
                break
            k, c = pick
            box = boxes[k][np.argsort(boxes[k][:, c], kind="stable")]
            boxes[k : k + 1] = [box[: len(box) // 2], box[len(box) // 2 :]]
        boxes.sort(key=len, reverse=True)
        return [(*np.floor(b.mean(axis=0) + 0.5).astype(int).tolist(), len(b)) for b in boxes]

    @F.pandas_udf("array<struct<r:int,g:int,b:int,n:int>>")
    def cuts(column):
        return column.map(lambda p: cut(np.array([[q["r"], q["g"], q["b"]] for q in p])))

    return sampled.select("image_id", F.posexplode(cuts("p")).alias("rank", "c")).select("image_id", "rank", "c.r", "c.g", "c.b", "c.n")


def dominant_color(pixels: DataFrame) -> DataFrame:
    return palette(pixels, 5).filter("rank = 0").drop("rank")


def dct_blocks(pixels: DataFrame) -> DataFrame:
    """image_id, bx, by, c21 and c12: two luma coefficients of each whole 8 x 8 block, from integers at a fixed scale of 10**6."""
    cosine = lambda v, k: F.element_at(F.array(*(F.lit(round(math.cos((2 * p + 1) * k * math.pi / 16) * 1_000_000)) for p in range(8))), (v % 8 + 1).cast("int"))
    rows = pixels.select("image_id", F.floor(F.col("x") / 8).alias("bx"), F.floor(F.col("y") / 8).alias("by"), "x", "y", LUMA1000().cast("long").alias("l"))
    sums = rows.groupBy("image_id", "bx", "by").agg(
        F.sum(F.col("l") * F.floor(cosine(F.col("x"), 2).cast("long") * cosine(F.col("y"), 1) / 1_000_000)).alias("c21"), F.sum(F.col("l") * F.floor(cosine(F.col("x"), 1).cast("long") * cosine(F.col("y"), 2) / 1_000_000)).alias("c12"), F.count(F.lit(1)).alias("n")
    )
    return sums.filter("n = 64").drop("n")


def lsb_capacity(pixels: DataFrame, keyed: bool = False) -> DataFrame:
    """Bits that fit in the opaque pixels' red, green and blue; a keyed walk uses half."""
    bits = F.count_if(F.col("a") == 255) * 3
    return pixels.groupBy("image_id").agg((F.floor(bits / 2) if keyed else bits).cast("long").alias("bits"))


def lsb_slots(pixels: DataFrame) -> DataFrame:
    """image_id, slot, x, y, channel: the n-th channel of opaque pixels in pixel order."""
    order = Window.partitionBy("image_id").orderBy("y", "x")
    rows = pixels.filter("a = 255").select("image_id", "x", "y", (F.row_number().over(order) - 1).alias("k"))
    return rows.select("image_id", "x", "y", F.posexplode(F.array(*map(F.lit, "rgb"))).alias("c", "channel"), "k").select("image_id", (F.col("k") * 3 + F.col("c")).alias("slot"), "x", "y", "channel")


def stride_sample(pixels: DataFrame, most: int = 4096) -> DataFrame:
    """Every n-th pixel in pixel order, n = max(1, pixels div most); needs width and height columns."""
    stride = F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / most))
    return pixels.filter((F.col("y") * F.col("width") + F.col("x")) % stride == 0)


def smallest(candidates: DataFrame, key: str = "image_id") -> DataFrame:
    """Of each key's candidates (ord, byte_count, ...) the smallest; the first wins ties."""
    rest = [c for c in candidates.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct("byte_count", "ord"))
    return candidates.groupBy(key).agg(best.alias("_b")).select(key, *(F.col(f"_b.{c}").alias(c) for c in rest))
