"""The queries of the image engine, by name, and the same queries as SQL.

Queries that make pixels return one row for each image: its number of pixels, channel sums, and a mark that weighs each channel of
each pixel by its place, so that a wrong pixel changes the row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import color, geometry
from rasterloom.operators import analysis, animation, marks, packed, pixelwise
from rasterloom.sources import exif, files, headers, png, relations

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PX = """px AS (SELECT p_partkey AS image_id, p_size AS width, 16 AS height, x::INTEGER AS x, y::INTEGER AS y, ((p_partkey * 31 + x * 7 + y * 13) % 256)::INTEGER AS r,
  ((x * y + p_partkey) % 256)::INTEGER AS g, ((p_partkey * 17 + x * 5) % 256)::INTEGER AS b, ALPHA AS a
  FROM (SELECT p_partkey, p_size, unnest(range(p_size)) AS x FROM part), (SELECT unnest(range(16)) AS y))"""
OPAQUE, VARIED = PX.replace("ALPHA", "255"), PX.replace("ALPHA", "((p_partkey * 7 + x * 3 + y * 11) % 256)::INTEGER")
EMB = """px AS (SELECT vec_id AS image_id, 8 AS width, 8 AS height, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, v AS r, v AS g, v AS b, 255 AS a FROM (
  SELECT vec_id, i, greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 1) * 127.5::DOUBLE + 0.5::DOUBLE)))::INTEGER AS v FROM embeddings, (SELECT unnest(range(64)) AS i)))"""
DIGEST = """SELECT image_id, count(*)::BIGINT AS n, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(a)::BIGINT AS sum_a,
  sum((r * 3 + g * 5 + b * 7 + a * 11)::BIGINT * (x * 131 + y * 137 + 1))::BIGINT AS mark FROM out GROUP BY image_id"""


def digest(pixels: DataFrame) -> DataFrame:
    weight = F.col("x") * 131 + F.col("y") * 137 + 1
    mark = F.sum((F.col("r") * 3 + F.col("g") * 5 + F.col("b") * 7 + F.col("a") * 11).cast("long") * weight)
    return pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).cast("long").alias(f"sum_{n}") for n in "rgba"), mark.cast("long").alias("mark"))


def add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = " ".join(sql.split())


def pixel_query(name: str, change: Callable[[DataFrame], DataFrame], out: str | None, varied: bool = False, source: str = "part") -> None:
    """A query of changed pixels; out is the SELECT that makes the same pixels from px."""
    read = relations.embedding_pixels if source == "embedding" else lambda s, d: relations.part_pixels(s, d, varied_alpha=varied)
    px = EMB if source == "embedding" else VARIED if varied else OPAQUE
    add(name, lambda s, d: digest(change(read(s, d))), None if out is None else f"WITH {px}, out AS ({out}) {DIGEST}")


def clamp(e: str) -> str:
    return f"least(255, greatest(0, round({e})))::INTEGER"


def rgb(f: Callable[[str], str]) -> str:
    return f"SELECT image_id, x, y, {', '.join(f'{f(c)} AS {c}' for c in 'rgb')}, a FROM px"


for _label, _src, _varied in (("", "part", False), ("_real", "embedding", False), ("_alpha", "part", True)):
    for _name, _f, _sql in (
        ("grayscale", color.grayscale(), rgb(lambda c: clamp("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"))),
        ("invert", color.invert(), rgb(lambda c: f"255 - {c}")),
        ("brightness", color.brightness(20), rgb(lambda c: clamp(f"{c} + 51"))),
        ("contrast", color.contrast(20), rgb(lambda c: clamp(f"({c} - 127.5::DOUBLE) * 1.44::DOUBLE + 127.5::DOUBLE"))),
        ("gamma", color.gamma(2.0), rgb(lambda c: clamp(f"pow({c} / 255.0::DOUBLE, 0.5::DOUBLE) * 255.0::DOUBLE"))),
        ("colorize", color.colorize((0, 0, 255)), rgb(lambda c: clamp(f"{c} * 0.5::DOUBLE + {127.5 if c == 'b' else 0.0}::DOUBLE"))),
        ("sepia", color.sepia(), rgb(lambda c: clamp(" + ".join(f"{w}::DOUBLE * {n}" for w, n in zip(color.SEPIA["rgb".index(c)], "rgb", strict=True))))),
        ("opacity", color.opacity(0.5), "SELECT image_id, x, y, r, g, b, " + clamp("a * 0.5::DOUBLE") + " AS a FROM px"),
    ):
        pixel_query(f"color_{_name}{_label}", lambda p, f=_f: pixelwise.apply(p, f), _sql, _varied, _src)

_HSL = """WITH1 h AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS t, least(r, g, b) / 255.0::DOUBLE AS l, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, b / 255.0::DOUBLE AS fb FROM px),
s AS (SELECT *, t - l AS d, (t + l) / 2 AS li FROM h),
u AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * li - 1)) END AS sat, (CASE WHEN d = 0 THEN 0 WHEN t = fr THEN CASE WHEN fg < fb THEN (fg - fb) / d + 6 ELSE (fg - fb) / d END WHEN t = fg THEN (fb - fr) / d + 2 ELSE (fr - fg) / d + 4 END) / 6 AS hu FROM s),
v AS (SELECT *, (hu + (40::DOUBLE / 360)) % 1 AS hh, least(1.0::DOUBLE, greatest(0.0::DOUBLE, sat * (1 + -30::DOUBLE / 100))) AS ss FROM u),
w AS (SELECT *, (1 - abs(2 * li - 1)) * ss AS c, hh * 6 AS h6 FROM v),
z AS (SELECT *, c * (1 - abs(h6 % 2 - 1)) AS m, li - c / 2 AS base, least(5, floor(h6)) AS k FROM w)"""
add(
    "color_hue_saturation",
    lambda s, d: digest(pixelwise.apply(relations.part_pixels(s, d), color.hue_saturation(40, -30))),
    f"WITH {OPAQUE}, " + _HSL.replace("WITH1 ", "") + ", out AS (SELECT image_id, x, y, " + ", ".join(clamp(f"((CASE k WHEN 0 THEN {p[0]} WHEN 1 THEN {p[1]} WHEN 2 THEN {p[2]} WHEN 3 THEN {p[3]} WHEN 4 THEN {p[4]} ELSE {p[5]} END) + base) * 255") + f" AS {n}" for n, p in (("r", "cm00mc"), ("g", "mccm00"), ("b", "00mccm"))) + f", a FROM z) {DIGEST}",
)

pixel_query("crop", lambda p: pixelwise.crop(p, 3, 2, 9, 7), "SELECT image_id, x - 3 AS x, y - 2 AS y, r, g, b, a FROM px WHERE x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 8")
add("crop_in_generator", lambda s, d: digest(pixelwise.crop(relations.part_pixels(s, d, box=(3, 2, 9, 7)), 3, 2, 9, 7)), _SQL["crop"])
pixel_query("crop_anchored", lambda p: pixelwise.crop_anchored(p, 10, 9, "bottom-right"), "SELECT image_id, x - greatest(0, width - 10) AS x, y - 7 AS y, r, g, b, a FROM px WHERE x >= width - 10 AND y >= 7")
pixel_query("flip_horizontal", lambda p: pixelwise.flip(p), "SELECT image_id, width - 1 - x AS x, y, r, g, b, a FROM px")
pixel_query("flip_vertical", lambda p: pixelwise.flip(p, False, True), "SELECT image_id, x, height - 1 - y AS y, r, g, b, a FROM px")
pixel_query("flip_both", lambda p: pixelwise.flip(p, True, True), "SELECT image_id, width - 1 - x AS x, height - 1 - y AS y, r, g, b, a FROM px")
pixel_query("rotate_90", lambda p: pixelwise.rotate(p, 90), "SELECT image_id, height - 1 - y AS x, x AS y, r, g, b, a FROM px")
pixel_query("rotate_180", lambda p: pixelwise.rotate(p, 180), "SELECT image_id, width - 1 - x AS x, height - 1 - y AS y, r, g, b, a FROM px")
pixel_query("rotate_270", lambda p: pixelwise.rotate(p, -90), "SELECT image_id, y AS x, width - 1 - x AS y, r, g, b, a FROM px")
pixel_query(
    "auto_orient",
    lambda p: pixelwise.auto_orient(p.withColumn("orientation", (F.col("image_id") % 8 + 1).cast("int"))),
    _ORIENTED := """SELECT image_id, CASE o WHEN 2 THEN width - 1 - x WHEN 3 THEN width - 1 - x WHEN 5 THEN y WHEN 6 THEN height - 1 - y WHEN 7 THEN height - 1 - y WHEN 8 THEN y ELSE x END AS x,
    CASE o WHEN 3 THEN height - 1 - y WHEN 4 THEN height - 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN width - 1 - x WHEN 8 THEN width - 1 - x ELSE y END AS y, r, g, b, a FROM (SELECT *, image_id % 8 + 1 AS o FROM px)""",
)
pixel_query(
    "pad",
    lambda p: pixelwise.pad(p, 2, 1, 3, 4, (9, 8, 7, 6)),
    """SELECT s.image_id, s.x, s.y, coalesce(px.r, 9) AS r, coalesce(px.g, 8) AS g, coalesce(px.b, 7) AS b, coalesce(px.a, 6) AS a FROM (SELECT p_partkey AS image_id, unnest(range(p_size + 5)) AS x, y FROM part, (SELECT unnest(range(21)) AS y)) s
    LEFT JOIN px ON px.image_id = s.image_id AND px.x = s.x - 2 AND px.y = s.y - 1""",
)
pixel_query(
    "resize_nearest",
    lambda p: pixelwise.resize_nearest(p, 20, 12),
    "SELECT px.image_id, t.x, u.y, r, g, b, a FROM px, (SELECT unnest(range(20)) AS x) t, (SELECT unnest(range(12)) AS y) u WHERE px.x = floor(t.x * px.width / 20.0::DOUBLE) AND px.y = floor(u.y * 16 / 12.0::DOUBLE)",
)
pixel_query(
    "rounded_corners",
    lambda p: pixelwise.rounded_corners(p, 5),
    """SELECT image_id, x, y, r, g, b, CASE WHEN dx <> 0 AND dy <> 0 AND dx * dx + dy * dy >= q * q THEN 0 ELSE a END AS a FROM (SELECT *, CASE WHEN x < q THEN q - 0.5::DOUBLE - x WHEN x >= width - q THEN x - (width - q - 0.5::DOUBLE) ELSE 0 END AS dx,
    CASE WHEN y < q THEN q - 0.5::DOUBLE - y WHEN y >= height - q THEN y - (height - q - 0.5::DOUBLE) ELSE 0 END AS dy FROM (SELECT *, least(5.0::DOUBLE, floor(least(width, height) / 2)) AS q FROM px))""",
)
add("trim_bounds", lambda s, d: pixelwise.trim_bounds(_bordered(s, d)), f"WITH {OPAQUE}, q AS (SELECT image_id, x, y, CASE WHEN x BETWEEN 2 AND width - 4 AND y BETWEEN 1 AND 12 THEN r % 2 + 1 ELSE 0 END AS v FROM px), b AS (SELECT image_id, min(x) FILTER (v > 0) AS l, max(x) FILTER (v > 0) AS r, min(y) FILTER (v > 0) AS t, max(y) FILTER (v > 0) AS u FROM q GROUP BY image_id) SELECT image_id, coalesce(l, 0)::INTEGER AS \"left\", coalesce(t, 0)::INTEGER AS top, (coalesce(r - l, 0) + 1)::INTEGER AS width, (coalesce(u - t, 0) + 1)::INTEGER AS height FROM b")


def _bordered(s: SparkSession, d: str) -> DataFrame:
    inner = F.col("x").between(2, F.col("width") - 4) & F.col("y").between(1, 12)
    return relations.part_pixels(s, d).withColumns({n: F.when(inner, F.col("r") % 2 + 1).otherwise(0) for n in "gb"} | {"r": F.when(inner, F.col("r") % 2 + 1).otherwise(0)})


def _overlay(s: SparkSession) -> DataFrame:
    x, y = (F.col("id") % 12).cast("int"), F.floor(F.col("id") / 12).cast("int")
    return s.range(120).select(x.alias("x"), y.alias("y"), (x * 20 % 256).alias("r"), (y * 25 % 256).alias("g"), ((x + y) * 11 % 256).alias("b"), ((x * y * 9) % 256).alias("a"))


_OVER = "ov AS (SELECT x::INTEGER + 2 AS x, y::INTEGER + 3 AS y, x * 20 % 256 AS sr, y * 25 % 256 AS sg, (x + y) * 11 % 256 AS sb, (x * y * 9) % 256 AS sa FROM (SELECT unnest(range(12)) AS x), (SELECT unnest(range(10)) AS y))"
# Fixed formulas of the separable modes, as SQL.
_BLEND_SQL = {
    "normal": "s", "multiply": "b * s", "screen": "b + s - b * s", "overlay": "CASE WHEN b <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END", "darken": "least(b, s)", "lighten": "greatest(b, s)",
    "color_dodge": "CASE WHEN s >= 1 THEN 1 ELSE least(1.0::DOUBLE, b / (1 - s)) END", "color_burn": "CASE WHEN s <= 0 THEN 0 ELSE 1 - least(1.0::DOUBLE, (1 - b) / s) END",
    "hard_light": "CASE WHEN s <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END",
    "soft_light": "CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) ELSE b + (2 * s - 1) * ((CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END) - b) END",
    "difference": "abs(b - s)", "exclusion": "b + s - 2 * b * s",
}


def _composite_sql(mode: str) -> str:
    def channel(n: str) -> str:
        back, over = f"({n} / 255.0::DOUBLE)", f"(s{n} / 255.0::DOUBLE)"
        f = re.sub(r"\b[bs]\b", lambda m: back if m[0] == "b" else over, _BLEND_SQL[mode])
        value = f"(fa * ((1 - ba) * {over} + ba * ({f})) + (1 - fa) * ba * {back}) / oa * 255"
        return f"CASE WHEN sa IS NULL OR fa <= 0 THEN {n} ELSE {clamp(value)} END AS {n}"

    return f"""WITH {VARIED}, {_OVER}, j AS (SELECT px.*, sr, sg, sb, sa, sa / 255.0::DOUBLE * 0.8::DOUBLE AS fa, a / 255.0::DOUBLE AS ba FROM px LEFT JOIN ov USING (x, y)),
    k AS (SELECT *, CASE WHEN fa + ba * (1 - fa) = 0 THEN 1 ELSE fa + ba * (1 - fa) END AS oa, fa + ba * (1 - fa) AS ra FROM j),
    out AS (SELECT image_id, x, y, {', '.join(map(channel, 'rgb'))}, CASE WHEN sa IS NULL OR fa <= 0 THEN a ELSE {clamp('ra * 255')} END AS a FROM k) {DIGEST}"""


for _mode in color.BLEND:
    add(f"blend_{_mode}", lambda s, d, m=_mode: digest(pixelwise.composite(relations.part_pixels(s, d, varied_alpha=True), _overlay(s), 2, 3, m, 0.8)), _composite_sql(_mode))
add(
    "mask",
    lambda s, d: digest(pixelwise.mask(relations.part_pixels(s, d, varied_alpha=True), _overlay(s))),
    f"WITH {VARIED}, {_OVER}, out AS (SELECT image_id, px.x, px.y, r, g, b, {clamp('a * sa / 255.0::DOUBLE')} AS a FROM px JOIN ov ON ov.x = px.x + 2 AND ov.y = px.y + 3) {DIGEST}",
)
add(
    "draw_shapes",
    lambda s, d: digest(pixelwise.draw(relations.part_pixels(s, d), [(pixelwise.rectangle(1, 1, 6, 4), (255, 0, 0, 255)), (pixelwise.ellipse(8, 8, 10, 6), (0, 255, 0, 255)), (pixelwise.polygon([(2, 9), (14, 9), (8, 15)]), (0, 0, 255, 255))])),
    f"""WITH {OPAQUE}, s AS (SELECT *, x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 4 AS p, pow((x - 8) * 2.0::DOUBLE / 10, 2) + pow((y - 8) * 2.0::DOUBLE / 6, 2) <= 1 AS e,
    y >= 9 AND y < 15 AND x >= 2 + (y - 9) AND x < 14 - (y - 9) AS t FROM px),
    out AS (SELECT image_id, x, y, CASE WHEN t THEN 0 WHEN e THEN 0 WHEN p THEN 255 ELSE r END AS r, CASE WHEN t THEN 0 WHEN e THEN 255 WHEN p THEN 0 ELSE g END AS g, CASE WHEN t THEN 255 WHEN e THEN 0 WHEN p THEN 0 ELSE b END AS b, a FROM s) {DIGEST}""",
)

_GRAY = rgb(lambda c: clamp("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"))
_MEAN = ", ".join(f"round(sum({n}) / count(*)::DOUBLE)::INTEGER AS {n}" for n in "rgba")
add("average_color", lambda s, d: analysis.average_color(pixelwise.apply(relations.part_pixels(s, d), color.grayscale())), f"WITH {OPAQUE}, out AS ({_GRAY}) SELECT image_id, {_MEAN} FROM out GROUP BY image_id")
add("histogram", lambda s, d: analysis.histogram(relations.embedding_pixels(s, d)), f"WITH {EMB} SELECT image_id, channel, value, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT image_id, '{n}' AS channel, {n} AS value FROM px" for n in "rgba") + ") GROUP BY ALL")
add("has_alpha", lambda s, d: analysis.has_alpha(relations.part_pixels(s, d, varied_alpha=True)), f"WITH {VARIED} SELECT image_id, bool_or(a <> 255) AS has_alpha FROM px GROUP BY image_id")
_PIXELATED = "SELECT image_id, x, y, " + ", ".join(f"round(sum({n}) OVER w / count(*) OVER w::DOUBLE)::INTEGER AS {n}" for n in "rgba") + " FROM px WINDOW w AS (PARTITION BY image_id, x // 4, y // 4)"
pixel_query("pixelate", lambda p: analysis.pixelate(p, 4), _PIXELATED, True)
_DHASH = f"""{OPAQUE}, gx AS (SELECT k AS gx FROM (SELECT unnest(range(9)) AS k)), gy AS (SELECT k AS gy FROM (SELECT unnest(range(8)) AS k)),
c AS (SELECT image_id, gy, gx, sum(299 * r + 587 * g + 114 * b)::BIGINT AS s, count(*) AS c FROM px, gx, gy WHERE x >= gx * width // 9 AND x < greatest((gx + 1) * width // 9, gx * width // 9 + 1) AND y >= gy * 16 // 8 AND y < greatest((gy + 1) * 16 // 8, gy * 16 // 8 + 1) GROUP BY ALL),
b AS (SELECT a.image_id, a.gy, a.gx, (a.s * n.c > n.s * a.c)::INTEGER AS bit FROM c a JOIN c n ON n.image_id = a.image_id AND n.gy = a.gy AND n.gx = a.gx + 1),
n AS (SELECT image_id, gy, gx // 4 AS half, sum(bit * [8, 4, 2, 1][gx % 4 + 1]) AS v FROM b GROUP BY ALL),
hs AS (SELECT image_id, string_agg(substr('0123456789abcdef', v::INTEGER + 1, 1), '' ORDER BY gy, half) AS hash FROM n GROUP BY image_id)"""
add("dhash", lambda s, d: analysis.dhash(relations.part_pixels(s, d)), f"WITH {_DHASH} SELECT image_id, hash FROM hs")
add(
    "dhash_hamming_pairs",
    lambda s, d: analysis.similar_pairs(analysis.dhash(relations.part_pixels(s, d)), 3),
    f"WITH {_DHASH}, u AS (SELECT hash, min(image_id) AS i FROM hs GROUP BY hash), p AS (SELECT a.i AS a, b.i AS b, list_sum(list_transform(range(1, 17), lambda k: bit_count(xor(strpos('0123456789abcdef', a.hash[k]) - 1, strpos('0123456789abcdef', b.hash[k]) - 1)))) AS distance FROM u a JOIN u b ON a.i < b.i) SELECT a, b, distance::INTEGER AS distance FROM p WHERE distance <= 3",
)
add("dhash_classes", lambda s, d: analysis.hash_classes(analysis.dhash(relations.part_pixels(s, d))), f"WITH {_DHASH} SELECT image_id, min(image_id) OVER (PARTITION BY hash) AS representative FROM hs")
add("lsb_capacity", lambda s, d: analysis.lsb_capacity(relations.part_pixels(s, d, varied_alpha=True)), f"WITH {VARIED} SELECT image_id, (count(*) FILTER (a = 255) * 3)::BIGINT AS bits FROM px GROUP BY image_id")
add("lsb_slots", lambda s, d: analysis.lsb_slots(relations.part_pixels(s, d, varied_alpha=True)), f"WITH {VARIED}, k AS (SELECT image_id, x, y, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k FROM px WHERE a = 255) SELECT image_id, (k * 3 + c)::BIGINT AS slot, x, y, ['r', 'g', 'b'][c + 1] AS channel FROM k, (SELECT unnest([0, 1, 2]) AS c)")
_COS = [[round(math.cos((2 * p + 1) * k * math.pi / 16) * 1_000_000) for p in range(8)] for k in range(3)]
add("dct_coefficients", lambda s, d: analysis.dct_blocks(relations.part_pixels(s, d)), f"WITH {OPAQUE}, l AS (SELECT *, (299 * r + 587 * g + 114 * b)::BIGINT AS l, ({_COS[1]}::BIGINT[])[x % 8 + 1] AS x1, ({_COS[2]}::BIGINT[])[x % 8 + 1] AS x2, ({_COS[1]}::BIGINT[])[y % 8 + 1] AS y1, ({_COS[2]}::BIGINT[])[y % 8 + 1] AS y2 FROM px) SELECT image_id, (x // 8)::BIGINT AS bx, (y // 8)::BIGINT AS \"by\", sum(l * floor(x2 * y1 / 1000000)::BIGINT)::BIGINT AS c21, sum(l * floor(x1 * y2 / 1000000)::BIGINT)::BIGINT AS c12 FROM l GROUP BY ALL HAVING count(*) = 64")
pixel_query("sample_stride", lambda p: analysis.stride_sample(p, 64), "SELECT image_id, x, y, r, g, b, a FROM px WHERE (y * width + x) % greatest(1, width * height // 64) = 0")
add("encode_smallest_argmin", lambda s, d: analysis.smallest(relations.table(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("int").alias("ord"), F.col("l_quantity").cast("long").alias("byte_count"))), "SELECT l_orderkey AS image_id, arg_min(l_linenumber, (l_quantity, l_linenumber))::INTEGER AS ord, min(l_quantity)::BIGINT AS byte_count FROM lineitem GROUP BY l_orderkey")

_FR = """fr AS (SELECT user_id AS animation_id, (row_number() OVER w - 1)::INTEGER AS frame_no, coalesce(least(655350, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000000), 0)::INTEGER AS delay_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
add("animation_duration", lambda s, d: animation.summary(relations.event_frames(s, d)), f"WITH {_FR} SELECT animation_id, count(*)::BIGINT AS frame_count, sum(delay_ms)::BIGINT AS duration_ms FROM fr GROUP BY animation_id")
add("animation_timeline", lambda s, d: animation.timeline(relations.event_frames(s, d)), f"WITH {_FR} SELECT animation_id, frame_no, delay_ms, (sum(delay_ms) OVER (PARTITION BY animation_id ORDER BY frame_no) - delay_ms)::BIGINT AS start_ms FROM fr")
add("animation_last_frame", lambda s, d: animation.last_frame(relations.event_frames(s, d)), f"WITH {_FR} SELECT animation_id, max(frame_no)::INTEGER AS frame_no, arg_max(delay_ms, frame_no)::INTEGER AS delay_ms FROM fr GROUP BY animation_id")


def _partial_frames(s: SparkSession, d: str) -> DataFrame:
    p = relations.part_pixels(s, d).withColumns({"animation_id": F.floor(F.col("image_id") / 4), "frame_no": (F.col("image_id") % 4).cast("int")})
    return p.withColumn("a", F.when((F.col("x") + F.col("y") + F.col("frame_no")) % 3 == 0, 255).otherwise(0))


add(
    "animation_keep_fold",
    lambda s, d: digest(animation.keep_fold(_partial_frames(s, d))),
    f"WITH {OPAQUE}, q AS (SELECT image_id, image_id // 4 AS animation_id, image_id % 4 AS f, x, y, r, g, b, CASE WHEN (x + y + image_id % 4) % 3 = 0 THEN 255 ELSE 0 END AS a FROM px), k AS (SELECT *, max(CASE WHEN a <> 0 THEN f END) OVER (PARTITION BY animation_id, x, y ORDER BY f) AS l FROM q), out AS (SELECT k.image_id, k.x, k.y, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b, coalesce(q.a, 0) AS a FROM k LEFT JOIN q ON q.animation_id = k.animation_id AND q.x = k.x AND q.y = k.y AND q.f = k.l) {DIGEST}",
)

_BOX = "bx AS (SELECT l_orderkey AS image_id, l_linenumber::INTEGER AS box_no, (l_partkey % 60 - 10)::INTEGER AS l, ((l_partkey * 7 + l_orderkey) % 40 - 10)::INTEGER AS t, (l_quantity::BIGINT % 30 + 1)::INTEGER AS w, ((l_partkey + l_quantity::BIGINT) % 25 + 1)::INTEGER AS h FROM lineitem)"


def _rect_pairs(s: SparkSession, d: str) -> DataFrame:
    boxes = relations.placements(s, d)
    a = boxes.select("image_id", *(F.col(c).alias("a_" + c) for c in boxes.columns[1:]))
    b = boxes.select("image_id", *(F.col(c).alias("b_" + c) for c in boxes.columns[1:]))
    cut = geometry.intersection(*({n: F.col(f"{p}_{n}") for n in ("left", "top", "w", "h")} for p in "ab"))
    return a.join(b, "image_id").filter("a_box_no < b_box_no").select("image_id", F.col("a_box_no").alias("a"), F.col("b_box_no").alias("b"), *(c.cast("int").alias(n) for n, c in cut.items())).filter("w IS NOT NULL")


add("rect_intersection_join", _rect_pairs, f"WITH {_BOX} SELECT a.image_id, a.box_no AS a, b.box_no AS b, greatest(a.l, b.l) AS \"left\", greatest(a.t, b.t) AS top, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l) AS w, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t) AS h FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.box_no < b.box_no WHERE least(a.l + a.w, b.l + b.w) > greatest(a.l, b.l) AND least(a.t + a.h, b.t + b.h) > greatest(a.t, b.t)")
add(
    "interval_merge",
    lambda s, d: animation.merge_ranges(relations.placements(s, d).select("image_id", F.col("left").alias("first"), (F.col("left") + F.col("w") - 1).alias("last"))),
    f'WITH {_BOX}, m AS (SELECT *, max(l + w - 1) OVER (PARTITION BY image_id ORDER BY l, l + w - 1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM bx), g AS (SELECT *, sum(CASE WHEN p IS NULL OR l > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY l, l + w - 1 ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT image_id, min(l)::INTEGER AS "first", max(l + w - 1)::INTEGER AS "last" FROM g GROUP BY image_id, g',
)


def _sizes_query(name: str, plan: Callable, w: str, h: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        out = plan(F.col("width"), F.col("height"))
        return relations.part_sizes(s, d).select("image_id", out[0].cast("int").alias("width"), out[1].cast("int").alias("height"))

    add(name, query, f"WITH s AS (SELECT p_partkey AS image_id, p_size::INTEGER AS width, 16 AS height FROM part) SELECT image_id, ({w})::INTEGER AS width, ({h})::INTEGER AS height FROM s")


_one = lambda e: f"greatest(1, round({e})::INTEGER)"
_IN, _OUT = "least(12.0::DOUBLE / width, 9.0::DOUBLE / height)", "greatest(12.0::DOUBLE / width, 9.0::DOUBLE / height)"
_sizes_query("scale", lambda w, h: geometry.scaled(w, h, 0.75), _one("width * 0.75::DOUBLE"), _one("height * 0.75::DOUBLE"))
_sizes_query("scale_to_width", lambda w, h: geometry.scaled_to_width(w, h, 30), "30", _one("30.0::DOUBLE / (width / height::DOUBLE)"))
_sizes_query("scale_to_height", lambda w, h: geometry.scaled_to_height(w, h, 30), _one("30.0::DOUBLE * (width / height::DOUBLE)"), "30")
_sizes_query("fit_inside", lambda w, h: geometry.fit_inside(w, h, (12, 9)), f"CASE WHEN width <= 12 AND height <= 9 THEN width ELSE {_one(f'width * {_IN}')} END", f"CASE WHEN width <= 12 AND height <= 9 THEN height ELSE {_one(f'height * {_IN}')} END")
_GROW = f"{_one(f'width * {_OUT}')} * {_one(f'height * {_OUT}')} > width * height"
_sizes_query("fit_outside", lambda w, h: geometry.fit_outside(w, h, (12, 9)), f"CASE WHEN {_GROW} THEN width ELSE {_one(f'width * {_OUT}')} END", f"CASE WHEN {_GROW} THEN height ELSE {_one(f'height * {_OUT}')} END")
_sizes_query("rotate_45_size", lambda w, h: geometry.rotated(w, h, 45), _one("width * cos(radians(45)) + height * sin(radians(45))"), _one("width * sin(radians(45)) + height * cos(radians(45))"))
_sizes_query("anchor_place", lambda w, h: geometry.anchored("bottom", w, h, F.lit(21), F.lit(5)), "trunc((width - 21) / 2)", "height - 5")
add("memory_estimate", lambda s, d: relations.part_sizes(s, d).select("image_id", geometry.memory_estimate(F.lit(1), F.col("width"), F.col("height")).alias("bytes")), "SELECT p_partkey AS image_id, (3 * p_size * 16 * 4)::BIGINT AS bytes FROM part")


def _limits(s: SparkSession, d: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    hit = geometry.violation({"width": w, "height": h, "pixels": w * h, "memory": geometry.memory_estimate(F.lit(1), w, h)}, {"width": 45, "pixels": 600, "memory": 96000})
    return relations.part_sizes(s, d).withColumn("v", hit).filter("v IS NOT NULL").select("image_id", "v.type", "v.actual", "v.allowed")


add("limits_violations", _limits, "SELECT image_id, type, actual, allowed FROM (SELECT p_partkey AS image_id, CASE WHEN p_size > 45 THEN 'width' WHEN p_size * 16 > 600 THEN 'pixels' WHEN p_size * 16 * 12 > 96000 THEN 'memory' END AS type, (CASE WHEN p_size > 45 THEN p_size WHEN p_size * 16 > 600 THEN p_size * 16 ELSE p_size * 192 END)::BIGINT AS actual, (CASE WHEN p_size > 45 THEN 45 WHEN p_size * 16 > 600 THEN 600 ELSE 96000 END)::BIGINT AS allowed FROM part) WHERE type IS NOT NULL")
add("palette", lambda s, d: analysis.palette(relations.embedding_pixels(s, d)))
add("dominant_color", lambda s, d: analysis.dominant_color(relations.embedding_pixels(s, d)))
add("blurhash", lambda s, d: analysis.blurhash(relations.embedding_pixels(s, d)))

#: The packed layout: files of PNG bytes, and operators on neighbourhoods.


def _png_files(s: SparkSession, d: str) -> DataFrame:
    return packed.to_png(packed.pack(relations.part_pixels(s, d, varied_alpha=True)))


def _packed_query(name: str, *kernels: packed.Kernel, out: str | None = None, source: str = "part") -> None:
    pixel_query(name, lambda p: packed.unpack(packed.change(packed.pack(p), *kernels)), out, source=source)


_SOFT = "(" + " + ".join(f"{(2 - abs(i)) * (2 - abs(j))} * n{i + 1}{j + 1}.C" for i in (-1, 0, 1) for j in (-1, 0, 1)) + ") / 16.0::DOUBLE"
_NEAR = " ".join(f"JOIN px n{i + 1}{j + 1} ON n{i + 1}{j + 1}.image_id = p.image_id AND n{i + 1}{j + 1}.x = greatest(0, least(7, p.x + {i})) AND n{i + 1}{j + 1}.y = greatest(0, least(7, p.y + {j}))" for i in (-1, 0, 1) for j in (-1, 0, 1))
_SHARP = ", ".join(clamp(f"p.{c} + (p.{c} - {_SOFT.replace('.C', '.' + c)})") + f" AS {c}" for c in "rgb")

pixel_query("png_round_trip", lambda p: packed.unpack(packed.from_png(packed.to_png(packed.pack(p)))), "SELECT * FROM px", True)
add(
    "png_probe",
    lambda s, d: _png_files(s, d).select("image_id", headers.identify(F.col("content")).alias("format"), headers.probe(F.col("content")).alias("p")).select("image_id", "format", "p.width", "p.height", "p.frames"),
    "SELECT p_partkey AS image_id, 'png' AS format, p_size::INTEGER AS width, 16 AS height, 1 AS frames FROM part WHERE p_size > 0",
)
add(
    "identify_documents",
    lambda s, d: relations.table(s, d, "documents").groupBy(F.coalesce(headers.identify(F.col("text").cast("binary")), F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'unknown' AS format, count(*)::BIGINT AS n FROM documents HAVING count(*) > 0",
)
_packed_query("sharpen", packed.sharpen(1.0), out=f"SELECT p.image_id, p.x, p.y, {_SHARP}, p.a FROM px p {_NEAR}", source="embedding")
_packed_query("blur", packed.blur(1.5))
_packed_query("resize_bilinear", packed.resize(24, 10, "bilinear"))
_packed_query("resize_bicubic", packed.resize(24, 10, "bicubic"))
_packed_query("resize_lanczos", packed.resize(24, 10, "lanczos"))
_packed_query("thumbnail_then_sharpen", packed.thumbnail(12, 12), packed.sharpen(0.5))
_packed_query("rotate_free", packed.rotate(30, (255, 255, 255, 255)))

pixel_query("pixelate_packed", lambda p: packed.unpack(packed.change(packed.pack(p), packed.pixelate(4))), _PIXELATED, True)
# the box that covers 12 x 12 in the image's shape, cut out at the middle, nearest pixels
_packed_query(
    "thumbnail_nearest",
    packed.thumbnail(12, 12, name="nearest"),
    out="""SELECT image_id, k.x, k.y, r, g, b, a FROM (SELECT *, greatest(1, round(width * f))::INTEGER AS nw, greatest(1, round(16 * f))::INTEGER AS nh FROM (SELECT p_partkey AS id, p_size AS width, greatest(12::DOUBLE / p_size, 12::DOUBLE / 16) AS f FROM part WHERE p_size > 0)) s,
    (SELECT x::INTEGER AS x, y::INTEGER AS y FROM (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y)) k
    JOIN px ON image_id = id AND px.x = (k.x + (nw - 12) // 2) * s.width // nw AND px.y = (k.y + (nh - 12) // 2) * 16 // nh""",
)

#: Files: headers, limits, orientation, decoding, animations.


def _turned_files(s: SparkSession, d: str) -> DataFrame:
    """PNG files with an orientation each."""
    chunks = F.udf(lambda content, k: bytes(content[:33]) + png._chunk(b"eXIf", exif.directory(k, "big" if k % 2 else "little")) + bytes(content[33:]), "binary")
    return _png_files(s, d).select("image_id", chunks("content", (F.col("image_id") % 8 + 1).cast("int")).alias("content"))


def _movies(s: SparkSession, d: str) -> DataFrame:
    """Each image, then its negative, as a GIF file that plays twice."""
    first = packed.pack(relations.embedding_pixels(s, d))
    second = packed.pack(pixelwise.apply(relations.embedding_pixels(s, d), color.invert()))
    frames = first.withColumns({"frame_no": F.lit(0), "delay_ms": F.lit(70)}).unionByName(second.withColumns({"frame_no": F.lit(1), "delay_ms": F.lit(130)}))
    return files.to_gif(frames, plays=2)


def _movie_frames(s: SparkSession, d: str) -> DataFrame:
    rows = files.decode(_movies(s, d)).select((F.col("image_id") * 1000 + F.col("delay_ms")).alias("image_id"), "width", "height", "data")
    return digest(packed.unpack(rows))


def _marked(s: SparkSession, d: str) -> DataFrame:
    own = packed.pack(relations.part_pixels(s, d)).withColumn("mark", F.concat(F.lit("part "), F.col("image_id")).cast("binary"))
    return marks.read(marks.embed(own, marks.LsbMark(), "mark"), marks.LsbMark()).select("image_id", "status", F.col("payload").cast("string").alias("payload"))


def _block_marked(s: SparkSession, d: str) -> DataFrame:
    large = packed.change(packed.pack(relations.embedding_pixels(s, d)), packed.resize(256, 256, "nearest")).withColumn("mark", F.col("image_id").cast("string").cast("binary"))
    key = marks.DctMark(key=b"secret")
    return marks.read(marks.embed(large, key, "mark"), key).select("image_id", "status", F.col("payload").cast("string").alias("payload"))


add("open_files", lambda s, d: digest(packed.unpack(files.decode(_turned_files(s, d)).filter("error IS NULL"))), f"WITH {VARIED}, out AS ({_ORIENTED}) {DIGEST}")
add(
    "open_files_limits",
    lambda s, d: files.inspect(_turned_files(s, d), {"width": 45, "pixels": 600}).select("image_id", "format", "width", "height", "orientation", "error"),
    """SELECT p_partkey AS image_id, 'png' AS format, p_size::INTEGER AS width, 16 AS height, (p_partkey % 8 + 1)::INTEGER AS orientation,
    CASE WHEN p_size > 45 THEN 'width is ' || p_size || ', the limit is 45' WHEN p_size * 16 > 600 THEN 'pixels is ' || p_size * 16 || ', the limit is 600' END AS error FROM part WHERE p_size > 0""",
)
add("gif_round_trip", _movie_frames, f"WITH {EMB}, out AS (SELECT image_id * 1000 + 70 AS image_id, x, y, r, g, b, a FROM px UNION ALL SELECT image_id * 1000 + 130, x, y, 255 - r, 255 - g, 255 - b, a FROM px) {DIGEST}")
add(
    "lsb_mark",
    _marked,
    "SELECT image_id, CASE WHEN fits THEN 'intact' ELSE 'absent' END AS status, CASE WHEN fits THEN mark END AS payload FROM (SELECT p_partkey AS image_id, 'part ' || p_partkey AS mark, p_size * 16 * 3 >= 8 * (11 + length('part ' || p_partkey)) AS fits FROM part WHERE p_size > 0)",
)
add("dct_mark", _block_marked, "SELECT vec_id AS image_id, 'authentic' AS status, vec_id::VARCHAR AS payload FROM embeddings")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
