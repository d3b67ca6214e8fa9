"""Whole measurements on rendered pictures: sliding windows, pooled angles, and pictures bent by a lens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acutance.operators import geometry, measure


def rendered(spark, squares, n, s, noise=20.0, k1=0.0):
    """A picture of dark squares (cx, cy, side, degrees) with logistic sides of scale s on a bright ground, bent by the division model."""
    y, x = (a.ravel() for a in np.mgrid[0:n, 0:n])
    half = math.hypot(n / 2, n / 2)
    px, py = (x - n / 2) / half, (y - n / 2) / half
    d = 1 + k1 * (px * px + py * py)
    sx, sy = px / d * half + n / 2, py / d * half + n / 2
    step = lambda t: 1 / (1 + np.exp(-np.clip(t / s, -60, 60)))
    dark = np.zeros(len(x))
    for cx, cy, side, angle in squares:
        a = math.radians(angle)
        u, v = (sx - cx) * math.cos(a) + (sy - cy) * math.sin(a), (sy - cy) * math.cos(a) - (sx - cx) * math.sin(a)
        dark += (step(u + side / 2) - step(u - side / 2)) * (step(v + side / 2) - step(v - side / 2))
    value = 45000 - 37000 * dark + np.random.default_rng(4).normal(0, noise, len(x))
    table = pa.table({"image_id": np.zeros(len(x), np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": value})
    return spark.createDataFrame(table), 2.1773189849653063 / (2 * math.pi**2 * s)


def test_windows_slide_along_the_long_sides(spark):
    px, expected = rendered(spark, [(90.3, 88.8, 96.0, 8.0)], 180, 0.9)
    rows = measure.measure_windows(px).collect()
    sides = {r.side for r in rows}
    assert len(sides) == 2
    for side in sides:
        own = sorted((r for r in rows if r.side == side), key=lambda r: r.window)
        assert [r.window for r in own] == list(range(len(own))) and len(own) >= 14
        steps = np.hypot(np.diff([r.cx for r in own]), np.diff([r.cy for r in own]))
        assert np.median(steps) == pytest.approx(4.0, abs=0.4)
    off = sorted(abs(r.mtf50 / expected - 1) for r in rows)
    assert off[len(off) // 2] < 0.02 and off[-1] < 0.06
    assert all(r.mtf50 < 1 and r.quality > 0.2 for r in rows)


def test_regions_of_interest_with_options(spark):
    """Regions on a gamma-coded picture, cropped, by both curve models and by one colour's sites."""
    px, expected = rendered(spark, [(90.3, 88.8, 96.0, 8.0)], 180, 0.9)
    coded = px.withColumn("v", F.rint(65535 * (1.055 * F.pow(F.col("v") / 65535, F.lit(1 / 2.4)) - 0.055)))
    t = math.radians(8)
    mid = lambda u: (90.3 + 48 * math.cos(u) - 10, 88.8 + 48 * math.sin(u) - 4)  # noqa: E731  the sides' middles after the crop
    rois = []
    for i in range(2):
        (x, y), a = mid(t + i * math.pi / 2), t + (i + 1) * math.pi / 2
        rois.append((0, i, x - 38 * math.cos(a), y - 38 * math.sin(a), x + 38 * math.cos(a), y + 38 * math.sin(a)))
    rois = spark.createDataFrame([*rois, (0, 9, 3.0, 3.0, 3.5, 3.0)], "image_id int, roi_id int, ax double, ay double, bx double, by double")
    options = spark.createDataFrame([(0, "srgb", 4, 175, 10, 175)], "image_id int, curve string, y0 int, y1 int, x0 int, x1 int")
    for model, tol in (("kernel", 0.02), ("loess", 0.03)):
        got = {r.roi_id: r.mtf50 for r in measure.measure_rois(coded, rois, model=model, options=options).collect()}
        assert {0, 1} <= set(got) and all(got[i] == pytest.approx(expected, rel=tol) for i in (0, 1))
    green = options.withColumns({"cfa": F.lit("rggb"), "colour": F.lit("g")})
    got = {r.roi_id: r.mtf50 for r in measure.measure_rois(coded, rois, options=green).collect()}
    assert all(got[i] == pytest.approx(expected, rel=0.05) for i in (0, 1))


def test_options_change_their_pictures_alone(spark):
    px = spark.createDataFrame([(i, y, x, 10 * y + x + 1) for i in (1, 2, 3, 4, 5) for y in range(4) for x in range(4)] + [(1, 0, 0, None)], "image_id int, y int, x int, v int")
    o = spark.createDataFrame([(2, "8bit", None, None, None, None, None, None, None), (3, None, True, None, None, None, None, None, None), (4, None, None, "rggb", "b", None, None, None, None), (5, None, None, None, None, 1, 2, 2, 3)], "image_id int, curve string, invert boolean, cfa string, colour string, y0 int, y1 int, x0 int, x1 int")
    got = {}
    for r in measure.prepared(px, o).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = r.v
    plain = {(y, x): 10.0 * y + x + 1 for y in range(4) for x in range(4)}
    assert got[1] == plain and got[2] == {p: 256 * v for p, v in plain.items()}
    assert got[3] == {p: 63 - v for p, v in plain.items()}
    assert got[4] == {p: v for p, v in plain.items() if p[0] % 2 and p[1] % 2}
    assert got[5] == {(y - 1, x - 2): plain[y, x] for y in (1, 2) for x in (2, 3)}


def test_windows_of_given_number(spark):
    e = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 40.0), (3, 0.0, 39.0), (4, -10.0, 45.0)], "edge_id int, lo double, hi double")
    got = {}
    for r in geometry.sliding_windows(e, ["edge_id"], most=5).collect():
        got.setdefault(r.edge_id, []).append((r.w0, r.w1))
    assert sorted(got[1]) == [(0.0, 40.0), (15.0, 55.0), (30.0, 70.0), (45.0, 85.0), (60.0, 100.0)]
    assert sorted(got[2]) == [(0.0, 40.0)] * 2 and 3 not in got and len(got[4]) == 4
    s = spark.createDataFrame([(1, 50.0), (1, 100.0), (1, 0.0), (1, -0.1), (2, 12.0), (4, 44.0)], "edge_id int, par double").withColumn("perp", F.lit(0.0))
    hit = geometry.window_samples(geometry.sliding_windows(e, ["edge_id"], most=5), s, ["edge_id"]).groupBy("edge_id", "par").agg(F.sort_array(F.collect_list("window")).alias("w"))
    assert {(r.edge_id, r.par): r.w for r in hit.collect()} == {(1, 50.0): [1, 2, 3], (1, 100.0): [4], (1, 0.0): [0], (2, 12.0): [0, 1], (4, 44.0): [3]}


def test_pooled_angles_are_nearer_than_single_ones(spark):
    rng, rows, truth = np.random.default_rng(9), [], {}
    for block in range(120):
        truth[block] = a = math.radians(rng.uniform(3, 40))
        for k in range(4):
            turn = a + k * math.pi / 2
            t, e = rng.uniform(-8, 8, 60), rng.normal(0, 0.5, 60)
            rows += [(block, k, float(x), float(y), 1.0) for x, y in zip(t * math.cos(turn) - e * math.sin(turn) + 50 * k, t * math.sin(turn) + e * math.cos(turn) - 30 * k, strict=True)]
    m = geometry.weighted_moments(spark.createDataFrame(rows, "block_id int, k int, x double, y double, w double"), ["block_id", "k"])
    edges = m.withColumn("angle", geometry.principal_axes()[2]).cache()
    off = lambda r: abs((r.angle - truth[r.block_id] - r.k * math.pi / 2 + math.pi / 2) % math.pi - math.pi / 2)
    single = {(r.block_id, r.k): off(r) for r in edges.collect()}
    got = geometry.pool_angles(edges, ["block_id"]).collect()
    pooled = [(off(r), single[r.block_id, r.k]) for r in got if r.pooled]
    assert len(got) == 480 and len(pooled) > 300
    assert np.sqrt(np.mean([a * a for a, _ in pooled])) < 0.9 * np.sqrt(np.mean([b * b for _, b in pooled]))  # pairs that differ much aren't pooled
    assert all(off(r) == pytest.approx(single[r.block_id, r.k], abs=1e-12) for r in got if not r.pooled)


def test_bent_pictures_come_back_in_two_passes(spark):
    squares = [(75 + 100 * i, 75 + 100 * j, 62.0, 6.0 + 9 * ((i + 2 * j) % 4)) for i in range(3) for j in range(3)]
    px, expected = rendered(spark, squares, 350, 1.5, noise=60.0, k1=-0.12)
    rows, found = measure.two_pass(px, rounds=6)
    k = found.first()
    at = lambda r: k.k1 * r * r + k.k2 * r**4  # noqa: E731  what k1 and k2 do together inside the picture
    assert at(0.7) == pytest.approx(-0.12 * 0.49, abs=0.006)
    off = sorted(abs(r.mtf50 / expected - 1) for r in rows.collect())
    assert len(off) >= 32 and off[len(off) // 2] < 0.02 and off[int(0.9 * len(off))] < 0.05


def test_pictures_are_measured_as_they_arrive(spark, tmp_path):
    from acutance.streaming import arrivals

    one, first = rendered(spark, [(60.0, 60.0, 64.0, 7.0)], 120, 0.8)
    two, second = rendered(spark, [(61.0, 59.0, 64.0, 21.0)], 120, 1.4)
    source, log, out = (f"file://{tmp_path}/{x}" for x in ("in", "log", "out"))
    for i, px in enumerate((one, two)):
        px.withColumn("image_id", F.lit(i)).coalesce(1).write.mode("append").parquet(source)
    arrivals.follow_pictures(spark, source, log, out).awaitTermination()
    got = spark.read.parquet(out).select("image_id", "side", "mtf50", "batch").collect()
    assert len(got) == 8 and len({(r.image_id, r.side) for r in got}) == 8
    for r in got:
        assert r.mtf50 == pytest.approx((first, second)[r.image_id], rel=0.02)


def bent_scale(row, n, k1):
    """How much finer a side's blur is in the bent picture than in the straight one: the gradient of the distance to its straight line, at its middle (given in the straight picture)."""
    half = math.hypot(n / 2, n / 2)
    ux, uy = (row.cx - n / 2) / half, (row.cy - n / 2) / half
    r = math.hypot(ux, uy)
    k = 2 / (1 + math.sqrt(1 - 4 * k1 * r * r))
    x, y = ux * k, uy * k
    d = 1 + k1 * (x * x + y * y)
    nx, ny = -math.sin(row.angle), math.cos(row.angle)
    # u = x / d: its derivatives, across the side
    gx = nx * (d - 2 * k1 * x * x) / d**2 + ny * (-2 * k1 * x * y) / d**2
    gy = nx * (-2 * k1 * x * y) / d**2 + ny * (d - 2 * k1 * y * y) / d**2
    return math.hypot(gx, gy)


def test_bent_sides_by_curves(spark):
    """A lens bends the sides by more than a pixel: a straight line blurs them, parabolas don't. Options choose for each picture."""
    px, expected = rendered(spark, [(91.0, 89.0, 120.0, 7.0)], 180, 0.5, k1=-0.1)
    three = px.unionByName(px.withColumn("image_id", F.lit(1))).unionByName(px.withColumn("image_id", F.lit(2)))
    options = spark.createDataFrame([(0, "line"), (1, "quadratic"), (2, None)], "image_id int, sampler string")
    off = {}
    for r in measure.measure_pictures(three, options=options, sampler="piecewise").collect():
        off.setdefault(r.image_id, []).append(r.mtf50 / (expected * bent_scale(r, 180, -0.1)) - 1)
    assert len(off) == 3 and all(len(own) == 4 for own in off.values())
    assert max(off[0]) < -0.04  # the straight line's loss
    assert max(map(abs, off[1] + off[2])) < 0.025


def test_bent_sides_measured_where_they_are(spark):
    px, expected = rendered(spark, [(91.0, 89.0, 120.0, 7.0)], 180, 0.5, k1=-0.1)
    rows = measure.measure_deferred(px, spark.createDataFrame([(0, -0.1, 0.0)], "image_id int, k1 double, k2 double")).collect()
    assert len(rows) == 4
    assert all(r.mtf50 == pytest.approx(expected * bent_scale(r, 180, -0.1), rel=0.025) for r in rows)


def test_straight_sides_by_parabolas(spark):
    px, expected = rendered(spark, [(90.3, 88.8, 96.0, 8.0)], 180, 0.9)
    rows = measure.measure_pictures(px, sampler="piecewise").collect()
    assert len(rows) == 4 and all(r.mtf50 == pytest.approx(expected, rel=0.01) for r in rows)
    with pytest.raises(ValueError):
        measure.measure_pictures(px, sampler="circle")
