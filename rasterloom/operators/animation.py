"""Animations: rows of frames (animation_id, frame_no, delay_ms) and their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import within


def summary(frames: DataFrame) -> DataFrame:
    """animation_id, frame_count, duration_ms."""
    return frames.groupBy("animation_id").agg(F.count(F.lit(1)).alias("frame_count"), F.sum("delay_ms").cast("long").alias("duration_ms"))


def with_delay(frames: DataFrame, delay_ms: int) -> DataFrame:
    return frames.withColumn("delay_ms", F.lit(int(within("delay", delay_ms, 0, 655350))))


def with_play_count(frames: DataFrame, plays: int) -> DataFrame:
    """0 plays forever."""
    return frames.withColumn("play_count", F.lit(int(within("play count", plays, 0, 65536))))


def timeline(frames: DataFrame) -> DataFrame:
    """frames with start_ms, the sum of the delays before."""
    order = Window.partitionBy("animation_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_ms", F.coalesce(F.sum("delay_ms").over(order), F.lit(0)).cast("long"))


def last_frame(frames: DataFrame) -> DataFrame:
    best = F.max_by("delay_ms", "frame_no")
    return frames.groupBy("animation_id").agg(F.max("frame_no").alias("frame_no"), best.alias("delay_ms"))


def from_frames(*images: DataFrame, animation_id: int = 0, delay_ms: int = 100) -> DataFrame:
    """An animation of images in order."""
    out = None
    for k, image in enumerate(images):
        own = image.withColumns({"animation_id": F.lit(animation_id).cast("long"), "frame_no": F.lit(k), "delay_ms": F.lit(delay_ms)})
        out = own if out is None else out.unionByName(own)
    return out


def keep_fold(pixels: DataFrame) -> DataFrame:
    """Full canvases from partial frames that all stay: at each place the last frame with alpha so far; a frame's rows with alpha 0 show what is below."""
    order = Window.partitionBy("animation_id", "x", "y").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("a") != 0, F.struct("r", "g", "b", "a")), ignorenulls=True).over(order)
    clear = F.struct(*(F.lit(0).alias(n) for n in "rgba"))
    return pixels.withColumn("_p", F.coalesce(seen, clear)).withColumns({n: F.col(f"_p.{n}") for n in "rgba"}).drop("_p")


def merge_ranges(ranges: DataFrame, key: str = "image_id") -> DataFrame:
    """Merges integer ranges (first, last, both included) that overlap or touch. Nulls come last, as in SQL.

    Equal ranges are in one order for both windows, which share one sort: with a sort for each, the one that begins a group could come second."""
    order = Window.partitionBy(key).orderBy(F.col("first").asc_nulls_last(), F.col("last").asc_nulls_last())
    top = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(top.isNull() | (F.col("first") > top + 1), 1).otherwise(0))
    grouped = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")
