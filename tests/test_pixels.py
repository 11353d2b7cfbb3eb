"""Golden values of single operations, and queries against SQL."""

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.functions import color, geometry
from rasterloom.operators import analysis, pixelwise

SF = "/root/testdata/sf0.001"


def one(spark, change, rgba):
    row = pixelwise.apply(spark.createDataFrame([(0, 0, 0, *rgba)], "image_id long, x int, y int, r int, g int, b int, a int"), change).first()
    return row.r, row.g, row.b, row.a


@pytest.mark.parametrize(
    ("change", "before", "after"),
    [
        (color.grayscale(), (200, 100, 50, 255), (124, 124, 124, 255)),
        (color.invert(), (200, 100, 50, 255), (55, 155, 205, 255)),
        (color.brightness(20), (200, 100, 50, 255), (251, 151, 101, 255)),
        (color.brightness(-100), (200, 100, 50, 255), (0, 0, 0, 255)),
        (color.contrast(20), (200, 100, 50, 255), (232, 88, 16, 255)),
        (color.contrast(-100), (200, 100, 50, 255), (128, 128, 128, 255)),
        (color.gamma(2), (200, 100, 50, 255), (226, 160, 113, 255)),
        (color.gamma(0.5), (200, 100, 50, 255), (157, 39, 10, 255)),
        (color.colorize((0, 0, 255)), (200, 100, 50, 255), (100, 50, 153, 255)),
        (color.opacity(0.5), (100, 150, 200, 128), (100, 150, 200, 64)),
        (color.sepia(), (100, 150, 200, 128), (192, 171, 134, 128)),
        (color.hue_saturation(120), (255, 0, 0, 123), (0, 255, 0, 123)),
        (color.hue_saturation(0, -100), (255, 0, 0, 123), (128, 128, 128, 123)),
        (color.hue_saturation(90, 50), (0, 0, 0, 255), (0, 0, 0, 255)),
        (color.hue_saturation(90, 50), (255, 255, 255, 255), (255, 255, 255, 255)),
    ],
)
def test_color(spark, change, before, after):
    assert one(spark, change, before) == after


@pytest.mark.parametrize("make", [lambda: color.brightness(101), lambda: color.gamma(0), lambda: color.gamma(float("nan")), lambda: color.opacity(1.1), lambda: color.hue_saturation(181), lambda: geometry.normalized(float("inf"))])
def test_bad_parameters(make):
    with pytest.raises(color.ParameterError):
        make()


def test_angles():
    assert geometry.normalized(-90) == 270 and geometry.normalized(720) == 0 and geometry.normalized(-1e-20) == 0


def test_pixelate_and_corners(spark):
    rows = [(0, k % 2, k // 2, v, v, v, 255) for k, v in enumerate((0, 100, 200, 255))]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    assert {r.r for r in analysis.pixelate(df, 2).collect()} == {139}
    white = spark.createDataFrame([(0, x, y, 255, 255, 255, 255, 4, 4) for x in range(4) for y in range(4)], "image_id long, x int, y int, r int, g int, b int, a int, width int, height int")
    alpha = {(r.x, r.y): r.a for r in pixelwise.rounded_corners(white, 2).collect()}
    assert alpha[0, 0] == alpha[3, 3] == 0 and alpha[1, 0] == 255


def test_palette_and_hashes(spark):
    colors = [(0, 0, 255), (0, 0, 255), (255, 0, 0), (255, 0, 0)]
    df = spark.createDataFrame([(0, k, 0, *c, 255) for k, c in enumerate(colors)], "image_id long, x int, y int, r int, g int, b int, a int")
    assert [(r.r, r.g, r.b) for r in analysis.palette(df, 2).orderBy("rank").collect()] == [(0, 0, 255), (255, 0, 0)]
    flat = spark.createDataFrame([(0, x, y, 9, 9, 9, 255, 9, 8) for x in range(9) for y in range(8)], "image_id long, x int, y int, r int, g int, b int, a int, width int, height int")
    assert analysis.dhash(flat).first().hash == "0" * 16
    pairs = spark.createDataFrame([("0" * 16, "0" * 15 + "1"), ("0" * 16, "f0" + "0" * 14), ("0" * 16, "f" * 16)], "a string, b string")
    assert [r.d for r in pairs.select(analysis.hamming(pairs.a, pairs.b).alias("d")).collect()] == [1, 4, 64]


def test_dodge_and_burn_at_the_ends(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.5, 0.5)], "b double, s double")
    got = df.select(*(color.BLEND[n](F.col("b"), F.col("s")).alias(n) for n in ("color_dodge", "color_burn"))).collect()
    assert [(r.color_dodge, r.color_burn) for r in got] == [(1.0, 0.0), (1.0, 0.0), (1.0, 0.0)]


def test_sizes_replace_older_ones(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 9), (1, 2, 1, 9, 9)], "image_id long, x int, y int, width int, height int")
    assert {(r.width, r.height) for r in pixelwise.sized(df).collect()} == {(3, 2)}


def test_classes_and_pairs_give_all_links(spark):
    hashes = {1: "0" * 16, 2: "0" * 16, 3: "0" * 15 + "1", 4: "0" * 15 + "1", 5: "0" * 15 + "1", 6: "f" * 16}
    df = spark.createDataFrame(list(hashes.items()), "image_id long, hash string")
    members = {}
    for r in analysis.hash_classes(df).collect():
        members.setdefault(r.representative, []).append(r.image_id)
    assert sorted(sum(members.values(), [])) == sorted(hashes)
    links = {(a, b) for m in members.values() for a in m for b in m if a < b}
    links |= {tuple(sorted((a, b))) for r in analysis.similar_pairs(df).collect() for a in members[r.a] for b in members[r.b]}
    far = lambda a, b: (int(hashes[a], 16) ^ int(hashes[b], 16)).bit_count()
    assert links == {(a, b) for a in hashes for b in hashes if a < b and far(a, b) <= 3}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "embeddings", "events", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_interval_merge_of_equal_and_missing_boxes(spark, tmp_path):
    # image, part, quantity: many equal boxes, one row each of a missing part (no box) and a missing quantity (no right end)
    rows = [(k % 500, k % 3 * 17 + 10, float(k % 4 * 3 + 2)) for k in range(9000)]
    rows += [(k, None, 5.0) for k in range(0, 500, 3)] + [(k, 10 + k % 60, None) for k in range(0, 500, 5)] + [(900, None, 5.0), (901, 12, None)]
    lines = spark.createDataFrame([(i, p, k, q) for k, (i, p, q) in enumerate(rows)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})  # its two windows are sorted alike by one thread alone
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["interval_merge"]).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    merged = catalog.queries()["interval_merge"](spark, str(tmp_path))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted(map(tuple, merged.collect()), key=key) == sorted(want, key=key)
