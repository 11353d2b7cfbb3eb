"""Lists of operations, overlays and the stream of arriving files."""

import numpy as np
import pytest

from rasterloom.functions.color import BLEND, ParameterError, channels, source_over
from rasterloom.operators import marks, overlay, packed, pixelwise
from rasterloom.plans import chain
from rasterloom.sources import png
from rasterloom.streaming import ingest

RNG = np.random.default_rng(9)
RASTER = RNG.integers(0, 256, (20, 30, 4), dtype=np.uint8)
OPAQUE = RASTER.copy()
OPAQUE[..., 3] = 255
INVERT = lambda r: np.concatenate([255 - r[..., :3], r[..., 3:]], axis=2)


def table(spark, *rasters):
    return spark.createDataFrame([(k, r.shape[1], r.shape[0], r.tobytes()) for k, r in enumerate(rasters)], packed.PACKED)


def test_hidden_marks_go_last(spark):
    mark = chain.Marked(marks.LsbMark(), b"mine")
    steps = [mark, INVERT, chain.Macro(lambda w, h: [packed.resize(w * 2, h, "nearest")]), chain.Region(INVERT, 1, 2, 3, 4)]
    assert chain.ordered(steps) == [*steps[1:], mark]
    rows = {r.image_id: r for r in chain.run(table(spark, OPAQUE, OPAQUE[:1, :1]), *steps).collect()}
    want = packed.resize(60, 20, "nearest")(INVERT(OPAQUE))
    want[2:6, 1:4] = INVERT(want[2:6, 1:4])
    assert bytes(rows[0].data) == marks.LsbMark().embed(want, b"mine").tobytes() and rows[0].error is None
    assert rows[1].data is None and "leaves" in rows[1].error
    with pytest.raises(ParameterError):
        chain.run(table(spark, OPAQUE), mark, output="jpeg")
    assert chain.run(table(spark, OPAQUE), INVERT, most_pixels=10).first().error
    with pytest.raises(ParameterError):
        chain.Region(lambda r: r[:1], 0, 0, 5, 5)(OPAQUE)


def test_blends_equal_the_columns(spark):
    top = RNG.integers(0, 256, (20, 30, 4), dtype=np.uint8)
    top[0, :, 3], top[1, :, :3], top[2, :, :3] = 0, 255, 0
    rows = [(x, y, *map(int, RASTER[y, x]), *map(int, top[y, x])) for y in range(20) for x in range(30)]
    df = spark.createDataFrame(rows, "x int, y int, r int, g int, b int, a int, sr int, sg int, sb int, sa int")
    named = {n: df[f"s{n}"] for n in "rgba"}
    for mode in BLEND:
        got = overlay.over(RASTER, top, mode, 0.7).astype(int)
        out = pixelwise.levels(df, source_over(channels(*"rgba"), named, mode, 0.7))
        want = np.zeros_like(got)
        for r in out.select("x", "y", *"rgba").collect():
            want[r.y, r.x] = r.r, r.g, r.b, r.a
        assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.001, mode


def test_visible_mark():
    red = np.zeros((2, 4, 4), np.uint8)
    red[:] = (255, 0, 0, 255)
    out = overlay.visible_mark(red, margin=1)(OPAQUE)
    assert (out[17:19, 25:29] == red[0, 0]).all() and (np.delete(out.reshape(-1, 4), [y * 30 + x for y in (17, 18) for x in range(25, 29)], 0) == np.delete(OPAQUE.reshape(-1, 4), [y * 30 + x for y in (17, 18) for x in range(25, 29)], 0)).all()
    half = overlay.visible_mark(red, "top-left", relative_width=0.5)(OPAQUE)
    assert (half[:8, :15] == red[0, 0]).all() and (half[8:] == OPAQUE[8:]).all()
    assert (overlay.composite(red, -3, -1)(OPAQUE)[:1, :1] == red[0, 0]).all() and (overlay.composite(red, 40, 0)(OPAQUE) == OPAQUE).all()
    for bad in ({"anchor": "x"}, {"opacity": 2}, {"mode": "x"}, {"relative_width": 0}):
        with pytest.raises(ParameterError):
            overlay.visible_mark(red, **bad)


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.png", png.encode(RASTER)), ("b.txt", b"text"), ("c.png", png.encode(RASTER)[:40])):
        (tmp_path / "in" / name).write_bytes(content)

    def drained(frame, name, mode):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    seen = {r.path.rsplit("/", 1)[1]: r for r in drained(ingest.decoded(spark, str(tmp_path / "in"), at_once=2), "frames", "append")}
    assert bytes(seen["a.png"].data) == RASTER.tobytes() and seen["b.txt"].error and seen["c.png"].error
    rows = drained(ingest.counts(ingest.arriving(spark, str(tmp_path / "in")), "3650 days"), "counts", "complete")
    assert {(r.format, r.n, r.refused) for r in rows} == {("png", 2, 0), (None, 1, 1)}
