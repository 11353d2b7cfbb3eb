"""Image files: read, checked against limits before anything is decoded, decoded to the packed layout, written.

A file that can't be read stays a row with null data and the reason in `error` (mode permissive), is left out (dropmalformed), or ends the
job (failfast). Files are told apart by content, never by name.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry
from rasterloom.functions.color import ParameterError
from rasterloom.sources import exif, gif, headers, png

#: The limits that hold unless others are given.
LIMITS = {"input_bytes": 50 << 20, "width": 16_384, "height": 16_384, "pixels": 50_000_000, "frames": 500, "animation_pixels": 200_000_000}
#: Media types and endings.
MEDIA = {"jpeg": ("image/jpeg", "jpg"), "png": ("image/png", "png"), "gif": ("image/gif", "gif"), "webp": ("image/webp", "webp"), "avif": ("image/avif", "avif"), "heic": ("image/heic", "heic")}
MODES = ("permissive", "dropmalformed", "failfast")
FRAMES = "frame_no int, delay_ms int, width int, height int, data binary, error string"


def read(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """path, modified, byte_count, content of files; folders are gone through. Spark's scan passes over files of no bytes, which so give no row."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        source = source.option("pathGlobFilter", glob)
    return source.load(list(paths)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("byte_count"), "content")


def inspect(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """files with format, width, height, frames, has_alpha, orientation and error: what their headers say, and the first limit that is exceeded."""
    limits = LIMITS | (limits or {})
    named = files.withColumn("format", headers.identify(F.col("content")))
    probed = named.withColumn("_p", headers.probe(F.col("content"), F.col("format"))).withColumn("orientation", exif.orientation(F.col("content"), F.col("format")))
    p = {n: F.col(f"_p.{n}") for n in ("width", "height", "frames", "has_alpha", "error")}
    pixels = p["width"].cast("long") * p["height"]
    known = {"input_bytes": F.length("content"), "width": p["width"], "height": p["height"], "pixels": pixels, "frames": p["frames"], "animation_pixels": pixels * p["frames"], "memory": geometry.memory_estimate(p["frames"], p["width"], p["height"])}
    over = geometry.violation(known, limits)
    said = F.when(over.isNotNull(), F.concat(over["type"], F.lit(" is "), over["actual"], F.lit(", the limit is "), over["allowed"]))
    return probed.select("*", *(p[n].alias(n) for n in ("width", "height", "frames", "has_alpha")), F.coalesce(said, p["error"]).alias("error")).drop("_p")


def _decoded(name: str, content: bytes, most: int) -> list[tuple[np.ndarray, int]]:
    if name == "png":
        return [(png.decode(content, most), 0)]
    if name == "gif":
        return gif.decode(content, most)
    raise headers.Broken(f"no decoder for {name} in Python workers")


def decode(files: DataFrame, key: str = "image_id", limits: dict[str, int] | None = None, mode: str = "permissive", orient: bool = True) -> DataFrame:
    """key, frame_no, delay_ms, width, height, data, error: one row a frame of PNG and GIF files, turned as their orientation says."""
    if mode not in MODES:
        raise ParameterError(f"unknown mode {mode}")
    most = (LIMITS | (limits or {}))["animation_pixels"]
    kind = files.schema[key].dataType
    checked = inspect(files, limits).select(key, "format", "orientation", "error", F.when(F.col("error").isNull(), F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, name, turn, error, content in zip(*batch.columns, strict=True):
                frames, said = [], error.as_py()
                if said is None:
                    try:
                        frames = _decoded(name.as_py(), content.as_py(), most)
                    except Exception as e:  # whatever a hostile file brings about is said of its row
                        said = str(e) or type(e).__name__
                rows = [(k, delay, turned(raster, turn.as_py()) if orient else raster) for k, (raster, delay) in enumerate(frames)]
                if said is not None and mode == "failfast":
                    raise ValueError(f"{own.as_py()}: {said}")
                if said is not None and mode == "dropmalformed":
                    continue
                for k, delay, raster in rows or [(0, 0, None)]:
                    size = (None, None) if raster is None else (raster.shape[1], raster.shape[0])
                    cols = [pa.array([own.as_py()], own.type), *(pa.array([v], pa.int32()) for v in (k, delay, *size)), pa.array([None if raster is None else np.ascontiguousarray(raster).tobytes()], pa.binary()), pa.array([said], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [key, "frame_no", "delay_ms", "width", "height", "data", "error"])

    return checked.mapInArrow(run, f"`{key}` {kind.simpleString()}, {FRAMES}")


def turned(raster: np.ndarray, orientation: int) -> np.ndarray:
    """The raster as an orientation tag says it is to be seen."""
    turns, mirror = geometry.ORIENTATIONS.get(orientation, (0, False))
    out = np.rot90(raster, -turns)
    return out[:, ::-1] if mirror else out


def read_jpeg(spark: SparkSession, *paths: str, glob: str = "*.{jpg,jpeg,JPG,JPEG}") -> DataFrame:
    """path, width, height, data of JPEG files, decoded in the JVM by Spark's own source; files that it can't decode have null data."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(list(paths)).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, many, data in zip(*batch.columns, strict=True):
                raster = None
                if h.as_py() > 0:
                    source = np.frombuffer(data.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), many.as_py())
                    raster = np.full((h.as_py(), w.as_py(), 4), 255, np.uint8)
                    raster[..., :3] = source[..., 2::-1] if many.as_py() > 1 else source
                    if many.as_py() == 4:
                        raster[..., 3] = source[..., 3]
                size = (None, None) if raster is None else (w.as_py(), h.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), *(pa.array([v], pa.int32()) for v in size), pa.array([None if raster is None else raster.tobytes()], pa.binary())], ["path", "width", "height", "data"])

    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, width int, height int, data binary")


def to_gif(frames: DataFrame, plays: int = 0) -> DataFrame:
    """image_id, content: one GIF file for each image's frames (image_id, frame_no, delay_ms, width, height, data), in their order.

    An animation's frames meet in one task; limits bound them before.
    """
    parts = frames.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "delay_ms", "width", "height", "data"))).alias("f"))

    @F.udf("binary")
    def write(rows):
        return gif.encode([(np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 4), r.delay_ms) for r in rows], plays)

    return parts.select("image_id", write("f").alias("content"))


def media_type(name: Column) -> Column:
    """The media type of a format's name."""
    return F.create_map(*(F.lit(v) for n, (m, _) in MEDIA.items() for v in (n, m)))[name]


def data_uri(content: Column, name: Column | None = None) -> Column:
    """The file as a data URI."""
    return F.concat(F.lit("data:"), media_type(headers.identify(content) if name is None else name), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def save(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content to folder/name, both on a file system that all executors mount: to another name first, then renamed, so that
    no reader meets half a file and a task that runs again does no harm. Returns name, byte_count and error of each row, when it is asked for rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(*batch.columns, strict=True):
                name, content = name.as_py(), content.as_py()
                error, part = None, None
                try:
                    if not name or name != os.path.basename(name) or name in (".", "..") or "\0" in name or content is None:
                        raise ValueError("no plain file name, or no content")
                    path = os.path.join(folder, name)
                    part = f"{path}.{uuid.uuid4().hex}.tmp"
                    with open(part, "xb") as f:
                        f.write(content)
                    if os.path.isfile(path):
                        os.chmod(part, os.stat(path).st_mode & 0o777)
                    os.replace(part, path)
                except (OSError, ValueError) as e:
                    error = str(e)
                    if part is not None and os.path.exists(part):
                        os.unlink(part)
                out.append((name, None if error else len(content), error))
            names, sizes, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["name", "byte_count", "error"])

    return files.select("name", "content").mapInArrow(run, "name string, byte_count long, error string")
