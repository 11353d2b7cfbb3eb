"""Image relations that are derived from plain tables, for tests and benchmarks where there are no image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEIGHT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height: one image for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("int").alias("width"), F.lit(HEIGHT).alias("height"))


def part_pixels(spark: SparkSession, sf_dir: str, box: tuple[int, int, int, int] | None = None, varied_alpha: bool = False) -> DataFrame:
    """Synthetic images; a box (left, top, width, height) bounds the generators, so a crop makes no pixel outside it."""
    left, top, w, h = box or (0, 0, 1 << 30, HEIGHT)
    xs = F.sequence(F.lit(left), F.least(F.col("width"), F.lit(left + w)) - 1)
    sizes = part_sizes(spark, sf_dir).filter(F.col("width") > left)
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(top), F.lit(min(HEIGHT, top + h) - 1)))).withColumn("x", F.explode(xs))
    i, x, y = F.col("image_id"), F.col("x"), F.col("y")
    alpha = ((i * 7 + x * 3 + y * 11) % 256).cast("int") if varied_alpha else F.lit(255)
    return rows.select("image_id", "width", "height", "x", "y", ((i * 31 + x * 7 + y * 13) % 256).cast("int").alias("r"), ((x * y + i) % 256).cast("int").alias("g"), ((i * 17 + x * 5) % 256).cast("int").alias("b"), alpha.alias("a"))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images from vectors of 64 components."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 1) * 127.5 + 0.5))).cast("int")
    return rows.select("image_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *(gray.alias(n) for n in "rgb"), F.lit(255).alias("a"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """animation_id, frame_no, delay_ms: each user's events are frames, the gap to the next one is the delay."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(at).over(order) - at
    delay = F.coalesce(F.least(F.lit(655350), F.floor(gap / 1_000_000)), F.lit(0)).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("animation_id"), (F.row_number().over(order) - 1).alias("frame_no"), delay.alias("delay_ms"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id (order), box_no (line) and a box for each order line."""
    k, p, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("image_id"), F.col("l_linenumber").cast("int").alias("box_no"), (p % 60 - 10).cast("int").alias("left"), ((p * 7 + k) % 40 - 10).cast("int").alias("top"), (q % 30 + 1).cast("int").alias("w"), ((p + q) % 25 + 1).cast("int").alias("h")
    )
