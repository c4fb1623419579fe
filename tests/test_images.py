"""Images, audio, layouts, lines and the columnar format against small cases worked out by hand or in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import geo
from tessel.operators import audio, cluster, images, treemap
from tessel.sources import columnar


def test_filters_keep_a_flat_image():
    flat = np.full((5, 7), 3.0)
    for f in (lambda x: images.gaussian(x, 1.2), lambda x: images.box(x, 2), lambda x: images.median(x, 1), images.opening, images.closing):
        assert np.allclose(f(flat), flat)
    for f in (images.sobel_x, images.sobel_y, images.scharr_y, images.gradient_magnitude, images.top_hat, images.black_hat):
        assert np.allclose(f(flat), 0)


def test_elements():
    assert images.element("cross", 3).sum() == 5
    assert images.element("rect", 5).sum() == 25
    assert images.element("ellipse", 5).sum() == 21


def test_bright_spot():
    spot = np.zeros((5, 5))
    spot[2, 2] = 1
    assert images.opening(spot).max() == 0 and images.top_hat(spot)[2, 2] == 1
    assert images.dilate(spot, "cross").sum() == 5
    assert images.gradient_direction(np.tile(np.arange(5.0), (5, 1)))[2, 2] == 0


def test_regions_against_flood_fill():
    rng = np.random.default_rng(3)
    for eight in (False, True):
        mask = rng.random((23, 17)) < 0.55
        got = images.regions(mask, eight)
        seen = np.zeros_like(got)
        c = 0
        for start in zip(*np.nonzero(mask), strict=True):
            if seen[start]:
                continue
            c += 1
            stack = [start]
            while stack:
                y, x = stack.pop()
                if not (0 <= y < 23 and 0 <= x < 17) or not mask[y, x] or seen[y, x]:
                    continue
                seen[y, x] = c
                stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not (i and j)]
        assert (got == seen).all()


def test_filtered_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 1, [2.0]), (2, 0, 0, []), (3, 0, 0, None)], "id int, width int, height int, pixels array<float>")
    got = {r.id: r.pixels for r in images.filtered(df, images.box, radius=1).collect()}
    assert got[1] == [2.0] and got[2] == [] and got[3] is None
    assert images.components(df, "id").collect()[0].area == 1


def test_treemap_cells(spark):
    cells = treemap.squarify([6.0, 6.0, 4.0, 3.0, 2.0, 2.0, 1.0], 0, 0, 6, 4)
    assert sum(w * h for _, _, w, h in cells) == pytest.approx(24)
    assert cells[0] == pytest.approx((0, 0, 3, 2)) and cells[1] == pytest.approx((0, 2, 3, 2))
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 0.0), ("b", "x", None)], "g string, k string, v double")
    got = treemap.treemap(df, ["g"], "k", "v").collect()
    assert sorted((r.k, round(r.w * r.h, 9)) for r in got) == [("x", 0.25), ("y", 0.75)]


def test_simplify(spark):
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0)]
    df = spark.createDataFrame([(line,), ([],), (line[:1],), (None,)], "line array<struct<x double, y double>>")
    got = [r.s if r.s is None else [(p.x, p.y) for p in r.s] for r in df.select(geo.simplify(F.col("line"), 0.1).alias("s")).collect()]
    assert got == [[line[0], line[2], line[4]], [], line[:1], None]


def test_columnar_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    df = spark.range(1000).select("id", (F.col("id") * 0.5).alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("goal"))
    columnar.write_columns(df, path, ["a", "b"], "goal", "id", b"TEST")
    back = columnar.read_columns(spark, path, magic=b"TEST", block=64)
    assert [tuple(r) for r in back.orderBy("row_id").collect()] == [(i, i * 0.5, float(i), float(i % 3)) for i in range(1000)]
    assert [tuple(r) for r in columnar.read_columns(spark, path, ["goal"], 5, 7).orderBy("row_id").collect()] == [(5, 2.0), (6, 0.0)]
    with pytest.raises(ValueError):
        columnar.header(path, b"ELSE")
    with pytest.raises(ValueError):
        columnar.read_columns(spark, path, ["none"])
    empty = str(tmp_path / "e.bin")
    columnar.write_columns(df.limit(0), empty, ["a"], "goal", "id", b"TEST")
    assert columnar.read_columns(spark, empty).count() == 0


def test_log_mel(spark):
    assert audio.mel_filters().shape == (80, 201) and audio.mel_filters().min() == 0
    t = np.arange(16_000) / 16_000
    mel = audio.spectrogram(np.sin(2 * np.pi * 1000 * t))
    assert mel.shape == (80, 100)
    assert mel[:, 50].argmax() == audio.mel_filters()[:, 25].argmax()
    assert mel.max() - mel.min() <= 2.0 + 1e-9
    df = spark.createDataFrame([(1, [0.0] * 320), (2, None)], "id int, samples array<float>")
    assert [(r.bands, r.frames) for r in audio.log_mel(df, "id").select("bands", "frames").collect()] == [(80, 3000), (80, 3000)]


def test_hdbscan(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [r.cluster for r in cluster.hdbscan(df, "id", "v").orderBy("id").collect()]
    assert len(set(got[:20])) == 1 and len(set(got[20:40])) == 1 and {got[0], got[20]} == {0, 1} and got[40] == -1
    assert {r.cluster for r in cluster.hdbscan(df.limit(3), "id", "v").collect()} == {-1}
    assert {r.cluster for r in cluster.hdbscan(df.where("id < 20"), "id", "v", 15).collect()} == {0}
    assert cluster.hdbscan(df.limit(0), "id", "v").count() == 0
