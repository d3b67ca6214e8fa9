"""Edges and lenses whose answers are known in closed form, and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acutance.operators import charts, esf, geometry, lens, measure, raster, spectrum, targets
from acutance.sources import tables
from acutance.streaming import arrivals

EK = ["edge_id"]


def test_logistic_edges_recover_mtf50(spark):
    scales = [0.7, 1.0, 1.5, 2.0]
    d = np.linspace(-30, 30, 4801)
    rows = [(i, float(x), 0.0, float(1000 / (1 + math.exp(-x / s)))) for i, s in enumerate(scales) for x in d]
    df = spark.createDataFrame(rows, "edge_id int, perp double, par double, v double")
    got = {r.edge_id: r.mtf50 for r in arrivals.run_corpus(df, EK).collect()}
    for i, s in enumerate(scales):
        assert got[i] == pytest.approx(2.1773189849653063 / (2 * math.pi**2 * s), rel=0.03)


def test_gaussian_edges_follow_their_blur(spark):
    sigmas = [0.9, 1.4, 2.2]
    d = np.linspace(-30, 30, 4801)
    rows = [(i, float(x), 0.0, float(500 * (1 + math.erf(x / s / math.sqrt(2))))) for i, s in enumerate(sigmas) for x in d]
    got = {r.edge_id: r.mtf50 for r in arrivals.run_corpus(spark.createDataFrame(rows, "edge_id int, perp double, par double, v double"), EK).collect()}
    for i, s in enumerate(sigmas):
        assert got[i] == pytest.approx(0.1873906251 / s, rel=0.04)


def test_pictures_give_the_values_of_their_edges(spark):
    """From pixels to values: every side of every target is found, and the values are within 2 % (p95) of the closed form."""
    from acutance.plans import catalog

    rows = catalog.queries()["t1_measure_pictures"](spark, "/root/testdata/sf0.001").collect()
    images = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert len(rows) == 4 * images and len({(r.image_id, r.side) for r in rows}) == 4 * images
    off = sorted(abs(r.mtf50 / r.expected - 1) for r in rows)
    assert off[int(0.95 * len(off))] < 0.02 and not any(r.contaminated for r in rows)


def test_pictures_without_targets(spark):
    px = spark.createDataFrame([(1, y, x, 1000.0 + (x * y) % 7) for y in range(40) for x in range(40)] + [(2, 0, 0, None)], "image_id int, y int, x int, v double")
    assert measure.measure_pictures(px).count() == 0
    assert measure.measure_pictures(px.where("image_id > 2")).count() == 0


def test_response_starts_at_one_and_ignores_partitioning(spark):
    rows = [(0, float(x), 0.0, float(np.tanh(x))) for x in np.linspace(-30, 30, 2401)]
    df = spark.createDataFrame(rows, "edge_id int, perp double, par double, v double")

    def sfr(x):
        s = spectrum.correct(spectrum.dft(esf.lsf(esf.pad_missing(esf.bin_triangular(x, EK), EK), EK), EK))
        return {r.k: r.m for r in s.collect()}

    a, b = sfr(df), sfr(df.repartition(7))
    assert a[0] == pytest.approx(1.0) and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_components_of_planted_shapes(spark):
    ring = [(0, y, x) for y in range(5, 25) for x in range(5, 25) if not (8 <= y < 22 and 8 <= x < 22)]
    bar = [(0, y, 40 + y) for y in range(30)]
    dots = [(0, 2, 60), (0, 4, 60), (1, 2, 60)]
    mask = spark.createDataFrame(ring + bar + dots, "image_id int, y int, x int")
    c = geometry.component_pixels(geometry.connected_components(geometry.runs(mask)))
    sizes = sorted(r["count"] for r in c.groupBy("image_id", "label").count().collect())
    assert sizes == sorted([len(ring), 30, 1, 1, 1])
    assert geometry.boundaries(c).where("x between 9 and 20 and y = 6").count() == 0


def test_distance_to_parabola(spark):
    rng = np.random.default_rng(1)
    pts = [(0, 0, float(y), float(x), 1) for x, y in rng.uniform(-20, 20, (40, 2))]
    fits = spark.createDataFrame([(0, 0, 0.03, -0.2, 1.0)], "image_id int, edge_id int, a double, b double, c double")
    got = geometry.sample_quadratic(spark.createDataFrame(pts, "image_id int, edge_id int, y double, x double, v int"), fits, ["image_id", "edge_id"]).collect()
    t = np.linspace(-60, 60, 240_001)
    for r in got:
        d = np.sqrt(((t - r.x) ** 2 + (0.03 * t * t - 0.2 * t + 1 - r.y) ** 2).min())
        assert abs(r.perp) == pytest.approx(d, abs=1e-3)


def _bent_ridges(spark, k1, k2, wild=()):
    """Thirty-six straight ridges bent by the division model, with noise across them; those in wild wave instead."""
    rng, rows = np.random.default_rng(5), []
    for i in range(36):
        a, cx, cy = i * 0.7, 0.7 * math.cos(i), 0.6 * math.sin(1.7 * i)
        for s in range(31):
            off = rng.normal(0, 1e-4) + (0.02 * math.sin(s / 3) if i in wild else 0)
            rows.append((i, s, cx + (s - 15) / 60 * math.cos(a) - off * math.sin(a), cy + (s - 15) / 60 * math.sin(a) + off * math.cos(a)))
    return lens.division_forward(spark.createDataFrame(rows, "ridge_id int, seq int, x double, y double"), k1, k2)


def test_distortion_fit_recovers_k1(spark):
    bent = _bent_ridges(spark, -0.1, 0.0).withColumn("image_id", F.lit(0)).union(_bent_ridges(spark, 0.15, -0.04).withColumn("image_id", F.lit(1)))
    found = {r.image_id: r for r in lens.fit_distortion(bent, ["ridge_id"], ["image_id"]).collect()}
    assert found[0].k1 == pytest.approx(-0.1, abs=0.01) and found[0].k2 == pytest.approx(0, abs=0.01)
    assert found[1].k1 == pytest.approx(0.15, abs=0.02) and found[1].k2 == pytest.approx(-0.04, abs=0.02)


def test_distortion_fit_drops_outlier_ridges(spark):
    bent = _bent_ridges(spark, -0.1, 0.0, wild={3, 11, 20}).withColumn("image_id", F.lit(0)).union(_bent_ridges(spark, -0.1, 0.0).withColumn("image_id", F.lit(1)))
    found = {r.image_id: r for r in lens.fit_distortion(bent, ["ridge_id"], ["image_id"], rounds=7).collect()}
    assert 3 <= found[0].dropped < 11 and found[0].ridges == 36
    assert found[0].k1 == pytest.approx(-0.1, abs=0.01) and found[0].cost < 1


def test_ridge_costs_are_inverse_durbin_watson(spark):
    bent = _bent_ridges(spark, -0.1, 0.02)
    cand = spark.createDataFrame([(0, 0.0, 0.0), (1, -0.1, 0.02)], "cand int, k1 double, k2 double")
    got = {(r.cand, r.ridge_id): r.t for r in lens.ridge_costs(bent, cand, ["ridge_id"]).collect()}
    rows = {}
    for r in sorted(bent.collect(), key=lambda r: (r.ridge_id, r.seq)):
        rows.setdefault(r.ridge_id, []).append((r.x, r.y))
    for i, pts in rows.items():
        p = np.array(pts)
        long = p[-1] - p[0]
        c, s = long / np.hypot(*long)
        for cand_id, k1, k2 in ((0, 0.0, 0.0), (1, -0.1, 0.02)):
            r2 = (p**2).sum(axis=1)
            q = p / (1 + k1 * r2 + k2 * r2 * r2)[:, None]
            u, v = q @ [c, s], q @ [-s, c]
            e = v - np.polyval(np.polyfit(u, v, 1), u)
            assert got[cand_id, i] == pytest.approx((e**2).sum() / (np.diff(e) ** 2).sum(), rel=1e-5)
    weights = spark.createDataFrame([(i, 1.0 if i < 5 else 0.0) for i in range(36)], "ridge_id int, weight double")
    cost = {r.cand: r.cost for r in lens.straightness(bent, cand, ["ridge_id"], weights=weights).collect()}
    assert cost[1] == pytest.approx(np.mean([got[1, i] for i in range(5)]))


def test_medcouple_equals_all_pairs():
    def pairs(x):
        mid = x[len(x) // 2]
        up, down = [v - mid for v in x[1:][::-1] if v >= mid], [v - mid for v in x if v <= mid]
        h = sorted(float(np.sign(len(up) - 1 - i - j)) if a == b else (a + b) / (a - b) for i, a in enumerate(up) for j, b in enumerate(down))
        return h[len(h) // 2]

    rng = np.random.default_rng(0)
    for k in range(400):
        n = rng.integers(5, 60)
        x = np.sort(rng.integers(0, rng.integers(2, 40), n) / 7 if k % 2 else rng.exponential(1, n) ** rng.integers(1, 4))
        assert lens.medcouple(x) == pytest.approx(pairs(x), abs=1e-12)
    assert -1 <= lens.medcouple(np.sort(rng.integers(0, 5, 200_000) / 1.0)) <= 1


def test_radial_models_invert(spark):
    p = spark.createDataFrame([(i, 0.1 * i - 1, 0.05 * i) for i in range(20)], "i int, x double, y double")
    for there, back in ((lambda q: lens.equiangular(q, 1.5), lambda q: lens.equiangular(q, 1.5, True)), (lambda q: lens.stereographic(q, 1.5), lambda q: lens.stereographic(q, 1.5, True)), (lambda q: lens.division_forward(q, -0.1), lambda q: lens.division_inverse(q, F.lit(-0.1), F.lit(0.0))), (lambda q: lens.division_forward(q, -0.1, 0.03), lambda q: lens.division_inverse(q, F.lit(-0.1), F.lit(0.03)))):
        for r in back(there(p)).collect():
            assert r.x == pytest.approx(0.1 * r.i - 1, abs=1e-9) and r.y == pytest.approx(0.05 * r.i, abs=1e-9)


def test_code_distance_is_not_levenshtein(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4]), ([1, 2, 3, 4], [1, 9, 3, 4]), ([1, 2, 3, 4], [5, 6, 7, 8]), ([1, 2, 3, 4], [2, 3, 4, 5])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(charts.edit_distance4(F.col("a"), F.col("b"))).collect()] == [0, 2, 8, 2]


def test_pose_there_and_back(spark):
    pose = spark.createDataFrame([(0, charts.rotation(3, -4, 5), [5.0, -3.0, 900.0], 1000.0, -0.05, 320.0, 240.0, 900.0)], "image_id int, r array<double>, t array<double>, f double, k1 double, px double, py double, centre_depth double")
    pts = spark.createDataFrame([(0, i, 10.0 * i - 100, 7.0 * i - 60) for i in range(20)], "image_id int, i int, x_mm double, y_mm double")
    there = charts.chart_to_image(pts, pose).select("image_id", "i", F.col("px_x").alias("ix"), F.col("px_y").alias("iy"))
    for r in charts.image_to_chart(there, pose).collect():
        assert r.x_mm == pytest.approx(10.0 * r.i - 100, abs=1e-5) and r.y_mm == pytest.approx(7.0 * r.i - 60, abs=1e-5)
    corr = charts.chart_to_image(pts, pose).select("image_id", "x_mm", "y_mm", F.col("px_x").alias("cx"), F.col("px_y").alias("cy"))
    assert charts.reprojection_rmse(corr, pose).first().rmse == pytest.approx(0, abs=1e-9)


def test_invert_clamps_at_an_exact_power(spark):
    px = spark.createDataFrame([(0, 0, 0, 256), (0, 0, 1, 10), (1, 0, 0, 0)], "image_id int, y int, x int, v int")
    assert {(r.image_id, r.x): r.v for r in raster.invert(px).collect()} == {(0, 0): 0, (0, 1): 245, (1, 0): 1}


def test_rois_of_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 4\nbad line\n 5\t6  7 8.5 \n1 2 3\n\n1 2 3 4 5\n")
    rows = tables.read_rois(spark, str(tmp_path)).collect()
    assert sorted((r.ax, r.ay, r.bx, r.by) for r in rows) == [(1, 2, 3, 4), (5, 6, 7, 8.5)]


def test_refused_images_have_a_reason(spark, tmp_path):
    images = spark.createDataFrame([(0, 16), (1, 32)], "image_id int, bit_depth int")
    px = spark.createDataFrame([(i, c, 0, x, 9) for i in (0, 1) for c in (0, 3) for x in range(3)], "image_id int, channel int, y int, x int, v int")
    path = str(tmp_path / "px")
    tables.scanlines(px).write.parquet(path)
    good, bad = tables.read_pixels(spark, path, images)
    assert sorted((r.image_id, r.channel, r.x) for r in good.collect()) == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]
    assert [(r.image_id, r.reason) for r in bad.collect()] == [(1, 5)]


def test_holes_of_planted_rings(spark):
    ring = [(0, y, x) for y in range(5, 25) for x in range(5, 25) if not (8 <= y < 22 and 8 <= x < 22)]
    solid = [(0, y, x) for y in range(30, 36) for x in range(30, 36)]
    px = spark.createDataFrame([(0, y, x, 0) for y in range(40) for x in range(40)], "image_id int, y int, x int, v int")
    comps = geometry.component_pixels(geometry.connected_components(geometry.runs(spark.createDataFrame(ring + solid, "image_id int, y int, x int"))))
    images = spark.createDataFrame([(0, 40, 40)], "image_id int, width int, height int")
    rows = targets.largest_hole(comps, px, images).collect()
    assert [r.hole_len for r in rows] == [4 * 14 - 4]


def test_unbounce_flips_once_after_a_null(spark):
    rows = [(0, k, (1 if k < 20 else -1) * (1 - k / 20) * (-1) ** k, 0.0, abs(1 - k / 20)) for k in range(40)]
    got = [r.m for r in spectrum.unbounce(spark.createDataFrame(rows, "edge_id int, k int, re double, im double, m double"), EK).orderBy("k").collect()]
    assert all(abs(abs(a) - r[4]) < 1e-12 for a, r in zip(got, rows)) and got[0] == 1.0


def test_loess_recovers_a_smooth_edge(spark):
    rng = np.random.default_rng(8)
    d = rng.uniform(-30, 30, 6000)
    rows = [(0, float(x), 0.0, float(1000 / (1 + math.exp(-x / 1.2)))) for x in d]
    got = targets.esf_loess(spark.createDataFrame(rows, "edge_id int, perp double, par double, v double"), EK).collect()
    for r in got:
        x = (r.bin - 256) / 8
        assert r.v == pytest.approx(1000 / (1 + math.exp(-x / 1.2)), abs=2.0)


def test_rational_fit_finds_the_peak(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, at in enumerate((3.0, -1.5)):
        for x in rng.uniform(-12, 12, 400):
            y = 0.4 / (1 + ((x - at) / 5) ** 2)
            rows.append((i, float(x), float(y * (1.3 if rng.random() < 0.02 else 1))))
    got = {r.edge_id: r.peak for r in targets.rational_fit(spark.createDataFrame(rows, "edge_id int, x double, y double"), EK, "x", "y").collect()}
    assert got[0] == pytest.approx(3.0, abs=0.1) and got[1] == pytest.approx(-1.5, abs=0.1)


def test_surface_of_a_plane(spark):
    rows = [(0, y, x, 0.01 * y + 0.02 * x) for y in range(0, 28, 2) for x in range(0, 28, 3)]
    got = targets.surface_fit(spark.createDataFrame(rows, "image_id int, gy int, gx int, v double"), ["image_id"], smooth=1e-6).collect()
    inside = [r for r in got if r.gy <= 24 and r.gx <= 24]
    assert inside and all(abs(r.v - 0.01 * r.gy - 0.02 * r.gx) < 1e-3 for r in inside)


@pytest.mark.parametrize("rows, columns", [(27, 40), (133, 200)])
def test_surface_covers_the_grid(spark, rows, columns):
    """Coarse and fine grids, wider than high; measured cells reach the far corner."""
    cells = [(0, y, x, 0.01 * y + 0.002 * x) for y in range(0, rows, 2) for x in range(columns - 1, -1, -3)]
    got = targets.surface_fit(spark.createDataFrame(cells, "image_id int, gy int, gx int, v double"), ["image_id"], smooth=1e-6, rows=rows, columns=columns).collect()
    assert {(r.gy, r.gx) for r in got} == {(y, x) for y in range(rows) for x in range(columns)}
    assert all(abs(r.v - 0.01 * r.gy - 0.002 * r.gx) < 1e-3 for r in got if (r.gy, r.gx) in {c[1:3] for c in cells[:: 97]} | {cells[0][1:3]})


def _loess(perp, v, width, cnr):
    """The same edge spread by a loop over bins."""
    at = np.argsort(perp)
    perp, v, mean, out = perp[at], v[at], 0.0, {}
    noise, penalty = zip(*targets.FEET_PENALTY, strict=True)
    for b in range(int(perp[0] * 8 + 257), int(perp[-1] * 8 + 255)):
        mid = (b - 256) / 8
        near = (perp >= mid - 2.25) & (perp < mid + 2.25)
        d = perp[near] - mid
        if near.sum() >= 7:
            if abs(mid) < width / 8 + 0.375:
                flat = 0.25 if abs(mid) >= width / 16 else 0.125
                w = np.where(np.abs(d) < flat, 1, np.exp(-13 * (np.abs(d) - flat)))
                design = w[:, None] * np.polynomial.chebyshev.chebvander(d / 2.25, 6)
                phi = np.interp(cnr, noise, penalty) if abs(mid) > 0.75 * width / 8 else 5e-8
                c = np.linalg.solve(design.T @ design + phi * np.eye(7), design.T @ (w * (v[near] - mean)))
                mean += c[0] + c[4] - c[2] - c[6]
            else:
                foot, middle, top = width / 8 + 0.375, width / 4, 2.25 * width / 8
                span = 1.5 if abs(mid) >= top else 1 + (abs(mid) - middle) / (top - middle) * 0.5 if abs(mid) >= middle else 0.24 + (abs(mid) - foot) / (middle - foot) * 0.76
                box = v[near][(d >= -span) & (d < span)]
                mean = box.mean() if len(box) else mean
        out[b] = mean
    return out


def test_loess_zones_equal_a_loop(spark):
    rng, rows, edges = np.random.default_rng(1), [], []
    for i, (s, noise, n, width, cnr) in enumerate([(0.5, 0.0, 900, 12, 1200.0), (1.2, 300.0, 700, 24, 33.0), (0.8, 900.0, 120, 18, 3.0)]):
        perp = rng.uniform(-28, 28, n)
        v = 2000 + 40000 / (1 + np.exp(-perp / s)) + rng.normal(0, 1, n) * noise
        rows += [(i, float(a), float(b)) for a, b in zip(perp, v, strict=True)]
        edges.append((perp, v, width, cnr))
    samples = spark.createDataFrame(rows, "edge_id int, perp double, v double")
    about = spark.createDataFrame([(i, e[2], e[3]) for i, e in enumerate(edges)], "edge_id int, half_width int, cnr double")
    got = {}
    for r in targets.esf_loess_zones(samples, about, EK).collect():
        got.setdefault(r.edge_id, {})[r.bin] = r.v
    for i, e in enumerate(edges):
        want = _loess(*e)
        assert set(got[i]) == set(want)
        assert max(abs(got[i][b] - want[b]) for b in want) < 1e-3 * 40000 * (1e-3 if i < 2 else 1)
    core = [(b, got[0][b]) for b in got[0] if abs(b - 256) < 40]
    assert max(abs(v - 2000 - 40000 / (1 + math.exp(-(b - 256) / 8 / 0.5))) for b, v in core) < 400


def _b3(t):
    """The cubic B-spline of the integer knots 0 .. 4."""
    t = np.asarray(t, float)
    pieces = [t**3 / 6, (-3 * t**3 + 12 * t**2 - 12 * t + 4) / 6, (3 * t**3 - 24 * t**2 + 60 * t - 44) / 6, (4 - t) ** 3 / 6]
    return np.select([(t >= i) & (t < i + 1) for i in range(4)], pieces, 0.0)


@pytest.mark.parametrize("rows, columns, share", [(21, 28, 0.3), (9, 50, 0.02), (33, 12, 0.004)])
def test_surface_equals_dense_spline_fit(spark, rows, columns, share):
    """All coefficients by one dense solve, empty intervals filled from the nearest ones: the same surface, dense and sparse."""
    rng = np.random.default_rng(rows)
    at = {(int(y), int(x)): float(rng.normal()) for y, x in zip(*np.nonzero(rng.random((rows, columns)) < share), strict=True)} or {(0, 0): 1.0}
    cells = spark.createDataFrame([(1, y, x, v) for (y, x), v in at.items()], "image_id int, gy int, gx int, v double")
    got = {(r.gy, r.gx): r for r in targets.surface_fit(cells, ["image_id"], smooth=0.01, rows=rows, columns=columns).collect()}
    sy, sx = (rows - 1) // 4 + 1, (columns - 1) // 4 + 1
    held = {}
    for (y, x), v in at.items():
        held.setdefault((y // 4, x // 4), []).append(v)
    value, far, wave = {p: np.mean(v) for p, v in held.items()}, dict.fromkeys(held, 0), 0
    while len(value) < sy * sx:
        wave += 1
        new = {}
        for y in range(sy):
            for x in range(sx):
                near = [value[p] for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if p in value]
                if (y, x) not in value and near:
                    new[y, x] = max(near)
        value |= new
        far |= dict.fromkeys(new, wave)
    points = [(y / 4, x / 4, v, 1.0) for (y, x), v in at.items()] + [(y + 0.5, x + 0.5, value[y, x], 1e-4) for y, x in value if far[y, x]]
    py, px, z, w = (np.array(c) for c in zip(*points, strict=True))
    basis = lambda y, x: (_b3(np.subtract.outer(y, np.arange(sy + 3) - 3))[:, :, None] * _b3(np.subtract.outer(x, np.arange(sx + 3) - 3))[:, None, :]).reshape(len(y), -1)
    c = basis(py, px)
    steps = lambda n: np.diff(np.eye(n), axis=0) * np.where(np.arange(n - 1) >= 2, 1.0, 0.5)[:, None]
    dy, dx = steps(sy + 3), steps(sx + 3)
    penalty = np.kron(dy.T @ dy, np.eye(sx + 3)) + np.kron(np.eye(sy + 3), dx.T @ dx)
    weight = 0.01 * (10 if len(held) < 0.6 * sy * sx else 1)
    x = np.linalg.solve(c.T @ (w[:, None] * c) + weight * penalty + 1e-9 * np.eye(c.shape[1]), c.T @ (w * z))
    gy, gx = (a.ravel() for a in np.mgrid[0:rows, 0:columns])
    want = basis(gy / 4, gx / 4) @ x
    assert len(got) == rows * columns
    assert max(abs(got[y, x].v - v) for y, x, v in zip(gy, gx, want, strict=True)) < 1e-7
    assert all(got[y, x].far == far[y // 4, x // 4] for y, x in zip(gy, gx, strict=True))


def test_shift_map_keeps_to_its_cells(spark):
    from acutance.operators import reports

    rows = [(1, "meridional", float(x), float(y), 0.004 * (x - 300)) for x in range(20, 600, 20) for y in range(20, 400, 20)] + [(1, "meridional", 300.0, 200.0, 99.0), (2, "meridional", 5.0, 5.0, 1.0)]
    m = spark.createDataFrame(rows, "image_id int, direction string, ex double, ey double, shift double")
    got = reports.ca_map(m, 600, 400, 10.0, "shift").collect()
    assert {r.image_id for r in got} == {1} and all(abs(r.v - 0.004 * (r.x - 300)) < 0.1 for r in got if 40 <= r.x <= 560 and 40 <= r.y <= 360)
    assert all(-1.12 <= r.v <= 1.12 for r in got)
    wide = {(r.x, r.y): r.v for r in got}
    for unit, scale in (("um", lambda x, y: 4.0), ("percent", lambda x, y: 100 / max(100, math.hypot(x - 300, y - 200)))):
        for r in reports.ca_map(m, 600, 400, 10.0, "shift", unit, 4.0).collect():
            if 60 <= r.x <= 540 and 60 <= r.y <= 340:
                assert r.v == pytest.approx(wide[r.x, r.y] * scale(r.x, r.y), abs=0.08 * scale(r.x, r.y) + 0.02)


def test_kernel_curves_recover_sharp_edges(spark):
    s = 0.6
    d = np.linspace(-30, 30, 4801)
    rows = [(0, float(x), 0.0, float(500 * (1 + math.erf(x / s / math.sqrt(2))))) for x in d]
    df = spark.createDataFrame(rows, "edge_id int, perp double, par double, v double")
    width = spark.createDataFrame([(0, 60)], "edge_id int, half_width int")
    curve = esf.tail_fill(esf.esf_kernel(df, width, EK), EK)
    sfr = spectrum.correct_kernel(spectrum.dft(esf.lsf(curve, EK), EK))
    assert spectrum.mtf_crossing(sfr, EK).first().mtf50 == pytest.approx(0.1873906251 / s, rel=0.01)


def test_piecewise_ridges(spark):
    from acutance.operators import sampling

    rows = [(i, float(x), 1 + 0.1 * (x - 10) + (-0.004 if x < 10 else 0.006 * (1 + i)) * (x - 10) ** 2) for i in range(3) for x in range(-30, 51)]
    fits = sampling.piecewise_fit(spark.createDataFrame(rows, "edge_id int, x double, y double"), EK)
    for r in fits.collect():
        assert abs(r.t - 10) <= 5
        worst = max(abs(r.c + r.b * (x - r.t) + (r.a1 if x < r.t else r.a2) * (x - r.t) ** 2 - y) for i, x, y in rows if i == r.edge_id)
        assert worst < 0.6
    pts = spark.createDataFrame([(0, float(x), float(y), 1) for x in (-20, 0, 30) for y in (-5, 2, 6)], "edge_id int, x double, y double, v int")
    got = sampling.sample_piecewise(pts, fits.where("edge_id = 0"), EK).collect()
    f = fits.where("edge_id = 0").first()
    t = np.linspace(-80, 100, 180_001)
    for r in got:
        a = f.a1 if r.x < f.t else f.a2
        d = np.sqrt(((t - r.x) ** 2 + (f.c + f.b * (t - f.t) + a * (t - f.t) ** 2 - r.y) ** 2).min())
        assert abs(r.perp) == pytest.approx(d, abs=5e-3)


def test_deferred_distance_is_straight_without_a_warp(spark):
    from acutance.operators import sampling

    e = spark.createDataFrame([(0, 2.0, 1.0, 0.4)], "image_id int, cx double, cy double, angle double")
    pts = spark.createDataFrame([(0, float(x), float(y), 1) for x in range(-6, 7, 3) for y in range(-6, 7, 4)], "image_id int, x double, y double, v int")
    for r in sampling.sample_deferred(pts, e, ["image_id"], lambda rows: rows).collect():
        want = (r.y - 1) * math.cos(0.4) - (r.x - 2) * math.sin(0.4)
        assert r.perp == pytest.approx(want, abs=1e-6)
        assert r.par == pytest.approx((r.x - 2) * math.cos(0.4) + (r.y - 1) * math.sin(0.4), abs=1e-6)


def test_band_and_rotation_and_widths(spark):
    from acutance.operators import reports

    rng = np.random.default_rng(6)
    rows = [(0, int(i), float(e)) for i, e in zip(rng.integers(5, 50, 300), np.abs(rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "edge_id int, i int, e double")
    got = [r.band for r in reports.spread_band(df, df, EK).orderBy("i").collect()]
    raw = []
    for i in range(64):
        near = sorted(round(e, 9) for _, j, e in rows if abs(i - j) <= 2)
        raw.append(near[min(len(near) - 1, math.floor(len(near) * 0.9))] if near else None)
    known = [i for i, v in enumerate(raw) if v is not None]
    full = [raw[i] if raw[i] is not None else float(np.interp(i, known, [raw[k] for k in known])) for i in range(64)]
    def run(x):
        out = []
        for v in x:
            out.append(v if not out else 0.35 * v + 0.65 * out[-1])
        return out
    want = run(run(full)[::-1])[::-1]
    assert got == pytest.approx(want, abs=1e-6)
    # a chart seen upright is sharpest in the middle; turned, it isn't
    rows = [(0, i, 0.5 - abs(i - 300) / 1000) for i in range(600)] + [(1, i, 0.2 + abs(i - 300) / 1000) for i in range(600)]
    turned = {r.image_id: r.rotated for r in reports.is_rotated(spark.createDataFrame(rows, "image_id int, at int, mtf double")).collect()}
    assert turned == {0: False, 1: True}
    rows = [(0, i, math.sin(i / 40) + 0.001 * (-1) ** i) for i in range(400)]
    fit = reports.loess_auto(spark.createDataFrame(rows, "edge_id int, i int, v double"), EK, "i", "v").collect()
    assert len(fit) == 400 and all(abs(r.fit - math.sin(r.i / 40)) < 0.05 for r in fit)


def test_colour_sites_keep_their_values_and_fill_the_rest(spark):
    rows = [(0, y, x, 10 * y + x) for y in range(8) for x in range(8)]
    got = {(r.y, r.x): r.v for r in raster.demosaic_red_blue(spark.createDataFrame(rows, "image_id int, y int, x int, v int")).collect()}
    assert all(v is not None for v in got.values())
    assert all(got[y, x] == 10 * y + x for y in range(0, 8, 2) for x in range(0, 8, 2))
    assert all(got[y, x] == 10 * y + x for y in range(2, 6) for x in range(2, 6))  # a plane stays a plane


def test_fiducial_code(spark):
    yy, xx = np.mgrid[0:60, 0:60]
    rho = np.hypot((xx - 30) / 20, (yy - 30) / 20)
    ang = (np.arctan2(yy - 30, xx - 30) + 2 * np.pi) % (2 * np.pi)
    v = np.where(rho > 1, 50000, 1000)
    v = np.where((rho > 0.4) & (rho < 0.6) & (ang < 2 * np.pi * 0.4), 50000, v)  # 2 of 5 parts of the outer ring
    v = np.where((rho > 0.24) & (rho < 0.36) & (ang < 2 * np.pi / 3), 50000, v)  # 1 of 3 of the inner
    v = np.where(rho < 0.15, 50000, v)
    px = spark.createDataFrame([(0, int(y), int(x), int(v[y, x])) for y in range(60) for x in range(60)], "image_id int, y int, x int, v int")
    e = spark.createDataFrame([(0, 7, 30.0, 30.0, 20.0, 20.0, 0.0)], "image_id int, fid int, cx double, cy double, major double, minor double, angle double")
    r = charts.decode_fiducial(px, e).first()
    assert (r.code, r.valid) == (4 * 2 + 1, True)


def _local_poly(xs, ys, n, sparse, least=20):
    """The same curve by loops over the places of one key."""
    data = sorted(zip(xs, ys, strict=True))
    span, m, more = data[-1][0] - data[0][0], len(data), []
    for i in range(5):
        more += [(data[i][0] - 0.01 * span, data[i][1]), (data[i][0] - 0.015 * span, data[i + 1][1]), (data[m - 1 - i][0] + 0.01 * span, data[m - 1 - i][1]), (data[m - 1 - i][0] + 0.015 * span, data[m - 2 - i][1])]
    full = sorted(data + more)
    out = {}
    for q in range(n):
        size = 3 if q < 0.2 * n or q >= 0.8 * n or len(full) < 80 else 4
        mid = data[0][0] + (q - 0.5) * span / (n - 2)
        lo, hi = sum(x < mid - span / 5 for x, _ in full), sum(x < mid + span / 5 for x, _ in full)
        while sparse and len(full) > least and hi - lo < least:
            lo, hi = max(lo - 1, 0), min(hi + 1, len(full))
        u = np.array([max(-1, min(1, (x - mid) / span)) for x, _ in full[lo:hi]])
        w = np.where(np.abs(u) < 0.2, (1 - (np.abs(u) * 5) ** 3) ** 3, 0) + (0.25 if sparse else 0)
        a = w[:, None] * u[:, None] ** np.arange(size)
        cov = a.T @ a
        if len(u) and np.linalg.eigvalsh(cov)[0] > 1e-12 * cov[0, 0]:
            out[q] = mid, np.linalg.solve(cov, a.T @ (w * [y for _, y in full[lo:hi]]))[0]
    return out


@pytest.mark.parametrize("sparse", [False, True])
def test_local_polynomials_equal_loops(spark, sparse):
    from acutance.operators import reports

    rng = np.random.default_rng(3)
    groups = {1: np.sort(rng.uniform(0, 400, 150)), 2: np.sort(rng.uniform(5, 300, 24)), 3: np.concatenate((rng.uniform(0, 30, 12), rng.uniform(380, 400, 13))), 4: np.array([1.0, 2, 3]), 5: np.full(9, 7.0)}
    ys = {g: 0.5 - 1e-6 * x**2 + rng.normal(0, 0.01, len(x)) for g, x in groups.items()}
    df = spark.createDataFrame([(g, float(a), float(b)) for g in groups for a, b in zip(groups[g], ys[g], strict=True)] + [(1, None, 1.0), (1, 2.0, None)], "g int, r double, v double")
    got = {}
    for r in reports.local_poly(df, ["g"], "r", "v", sparse=sparse).collect():
        got.setdefault(r.g, {})[r.i] = r.x, r.y
    assert set(got) == {1, 2, 3}
    for g in got:
        want = _local_poly(groups[g].tolist(), ys[g].tolist(), 64, sparse)
        assert len(set(want) ^ set(got[g])) <= 2 and (not sparse or len(got[g]) == 64)
        for i in set(want) & set(got[g]):
            assert got[g][i][0] == pytest.approx(want[i][0]) and got[g][i][1] == pytest.approx(want[i][1], abs=1e-5)


def test_profile_points_at_three_frequencies(spark):
    from acutance.operators import reports

    m = spark.createDataFrame([(1, 1, 420.0, 240.0, 0.0, 0.4, 1.0), (1, 2, 320.0, 140.0, 3.0, 0.4, 1.0), (1, 3, 420.0, 340.0, 0.0, 0.4, 1.0), (1, 4, 420.0, 240.0, 0.0, 1.0, 1.0), (1, 5, 420.0, 240.0, 0.0, 0.4, 0.3)], "image_id int, edge_id int, ex double, ey double, angle double, mtf double, quality double")
    sfr = m.select("image_id", "edge_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).withColumn("m", 1 - F.col("k") / 64.0)
    got = {(r.direction, r.freq): (r.radius, r.contrast) for r in reports.profile_points(m, sfr, ["image_id", "edge_id"], 320, 240, [0.1, 0.25, 0.33]).collect()}
    assert len(got) == 6 and {d for d, _ in got} == {"meridional", "sagittal"}
    assert all(r == pytest.approx(100) and c == pytest.approx(1 - f) for (_, f), (r, c) in got.items())
    with pytest.raises(ValueError):
        reports.profile_points(m, sfr, ["image_id", "edge_id"], 320, 240, [0.1] * 4)


def _autocrop(v, border):
    """The same crop by loops over the places of an axis."""

    def otsu(values):
        best, at = -1.0, []
        for t in sorted(set(values)):
            low, high = [x for x in values if x <= t], [x for x in values if x > t]
            if high:
                c = float(len(low)) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
                at = [t] if c > best * (1 + 1e-12) else [*at, t] if abs(c - best) <= 1e-12 * best else at
                best = max(best, c)
        return (min(at) + max(at)) / 2

    n, t = len(v), otsu(v)
    left, right = 0, n - 1
    while v[left] < t and left < n // 4:
        left += 1
    if left < 0.1 * n:
        while v[left] > t and left < n // 4:
            left += 1
    else:
        left = 0
    while v[right] < t and right > 3 * n // 4:
        right -= 1
    if right > 0.9 * n:
        while v[right] > t and right > 3 * n // 4:
            right -= 1
    else:
        right = n - 1
    if left > 0 or right < n - 1:
        middle = sorted(v)[n // 2]
        t = otsu([middle if x > t else x for x in v])
    last = max((i for i in range(left, n) if v[i] > t), default=left)
    first = min((i for i in range(1, right + 1) if v[i] > t), default=right)
    lo, hi = first - border, min(n - 1, last + border)
    return max(0, lo + lo % 2), hi - hi % 2


def test_margins_equal_loops(spark):
    from acutance.operators import raster

    rng, rows, want = np.random.default_rng(4), [], {}
    for image in range(24):
        n = int(rng.integers(60, 140))
        v = rng.integers(20, 40, n) + (np.abs(np.arange(n) - n / 2) < n * rng.uniform(0.1, 0.3)) * 60
        if image % 3:
            v[: int(n * rng.uniform(0.02, 0.2))] += rng.integers(50, 200)
        if image % 4 == 1:
            v[-int(n * rng.uniform(0.02, 0.2)) :] += 90
        rows += [(image, "row", i, float(x) / 20) for i, x in enumerate(v)]
        want[image] = _autocrop(v.tolist(), 5)
    got = raster.autocrop_margins(spark.createDataFrame(rows, "image_id int, axis string, at int, s double"), 5).collect()
    assert {r.image_id: (r.lo, r.hi) for r in got} == want


def test_bars_of_planted_pictures(spark):
    """Dark bars near top and bottom are cut off along their lines; pictures without them stay whole."""
    from acutance.operators import raster

    n = 200
    rows = []
    for image in (0, 1):
        for y in range(n):
            for x in range(100):
                top, bottom = image == 0 and 10 + x // 25 <= y < 14 + x // 25, image == 0 and 185 <= y < 189
                rows.append((image, y, x, 1000 if top or bottom or 60 <= y < 120 and 30 <= x < 70 else 50000 + 100 * (x % 5)))
    px = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    images = spark.createDataFrame([(0, 100, n), (1, 100, n)], "image_id int, width int, height int")
    crop = {r.image_id: r for r in raster.bar_crop(px, images, lambda pts, keys: targets.robust_line(pts, keys), 20000).collect()}
    assert (crop[1].y0, crop[1].y1) == (0, n - 1)
    assert 17 <= crop[0].y0 <= 19 and crop[0].y1 in (181, 182, 183)
    values = sorted(v for i, _, _, v in rows if i == 0)
    assert sum(v >> 3 <= crop[0].fill >> 3 for v in values) <= 0.75 * len(values) < sum(v >> 3 <= (crop[0].fill >> 3) + 1 for v in values)


def clipped_by_loops(samples, passes=3):
    """B5 as loops over one edge's samples (perp, v): left, right, clipped, contaminated."""
    left, right, clipped, dirty = 0, 511, False, False
    for number in range(passes):
        total, weight = np.zeros(512), np.zeros(512)
        for perp, v in samples:
            c = int(perp * 8 + 256)
            for b in range(max(0, c - 5), min(511, c + 5) + 1):
                w = 1 - 1.75 * abs(perp - (b - 256) / 8)
                if w > 0 and left <= b <= right:
                    total[b] += w * v
                    weight[b] += w
        have = np.flatnonzero(weight)
        curve = np.zeros(512)
        for b in range(512):
            below = have[have <= b]
            near = below[-1] if len(below) else have[0]
            curve[b] = total[near] / weight[near]
        slope = np.zeros(512)
        for b in range(16, 496):
            slope[b] = np.polyfit(np.arange(-16, 17), curve[b - 16 : b + 17], 1)[0]
        core = range(240, 273)
        peak = slope[max(core, key=lambda b: (round(abs(slope[b]), 9), -b))]

        def turned(b, beyond):
            if not (slope[b] * peak < 0 and abs(slope[b]) > abs(peak) * 0.001):
                return False
            against = [abs(slope[k]) for k in beyond if slope[k] * peak < 0]
            n = len(beyond)
            return (len(against) > 0.4 * n and max(against) / abs(peak) > 0.25) or (len(against) > 0.9 * n and n > 16)

        lo = next((b for b in range(240, left + 3, -1) if turned(b, range(left, b + 1))), None)
        hi = next((b for b in range(272, right - 3) if turned(b, range(b, right + 1))), None)
        if lo is None and hi is None:
            break
        left, right, clipped = left if lo is None else lo, right if hi is None else hi, True
        dirty = dirty or 256 - left < 32 or right - 256 < 32
    return left, right, clipped, dirty


def test_clipping_in_passes(spark):
    rng, rows = np.random.default_rng(11), {}
    dents = {0: [], 1: [(9.0, -900)], 2: [(-17.0, 800), (-6.0, 700)], 3: [(5.0, -1200), (18.0, -700)], 4: [(-3.0, 2500), (12.0, -1500)], 5: [(20.0, -400), (11.0, -250), (6.0, -150)]}
    for edge, bumps in dents.items():
        perp = rng.uniform(-27, 27, 2500)
        v = 2000 + 8000 / (1 + np.exp(-perp / 0.6)) + rng.normal(0, 5, 2500)
        for at, rise in bumps:
            v += np.where(perp > at, rise * (perp - at) / 3, 0) if at > 0 else np.where(perp < at, rise * (at - perp) / 3, 0)
        rows[edge] = list(zip(perp.tolist(), v.tolist(), strict=True))
    s = spark.createDataFrame([(e, p, v) for e, own in rows.items() for p, v in own], "edge_id int, perp double, v double")
    slope = esf.slopes(esf.pad_missing(esf.bin_triangular(s, EK), EK), EK)
    got = {r.edge_id: (r.left, r.right, r.clipped, r.contaminated) for r in esf.clip_repeatedly(s, slope, EK).collect()}
    assert got == {e: clipped_by_loops(own) for e, own in rows.items()}
    once = {r.edge_id: (r.left, r.right) for r in esf.clip_contaminated(slope, EK).collect()}
    assert once == {e: clipped_by_loops(own, 1)[:2] for e, own in rows.items()}
    assert got[0] == (0, 511, False, False) and sum(g[2] for g in got.values()) >= 4


def test_reference_edge_of_lone_blocks_and_poor_quality(spark):
    from acutance.operators import reports

    m = spark.createDataFrame([(1, 1, 7, 10.0, 50.0, 0.2, 0.1), (1, 1, 8, 10.0, 90.0, 0.3, 1.0), (2, 1, 1, 0.0, 10.0, 0.2, 1.0), (2, 2, 2, 0.0, 30.0, 0.4, None), (2, 2, 3, 0.0, 70.0, 0.5, 1.0), (3, 1, 9, 0.0, 0.0, 0.1, 1.0)], "image_id int, block_id int, edge_id int, ex double, ey double, mtf double, quality double")
    areas = spark.createDataFrame([(1, 1, 5.0), (2, 1, 4.0), (2, 2, 9.0), (3, 1, 1.0)], "image_id int, block_id int, area double")
    curve = spark.createDataFrame([(1, 40, 0.25), (1, 60, 0.35), (1, 80, 0.35), (2, 20, 0.6), (2, 40, None), (2, 60, 0.1)], "image_id int, at int, value double")
    got = {r.image_id: (r.block_id, r.edge_id, r.shift, r.on_curve, r.mtf, r.good) for r in reports.reference_edge(m, areas, curve).collect()}
    assert got == {1: (1, 7, -10.0, 0.25, 0.35, False), 2: (2, 2, 10.0, 0.6, 0.6, False)}  # image 3 has no curve
    assert reports.reference_edge(m.limit(0), areas.limit(0), curve.limit(0)).count() == 0


def test_a_pixel_on_the_limit_of_a_segment_is_inside(spark):
    """(-10 * 22.5 + 6 * 12) / 25.5 is -6: right on the limit."""
    pixel = spark.createDataFrame([(5, 31, 15, 7)], "image_id int, y int, x int, v int")
    segment = spark.createDataFrame([(5, 181, 9.0, 41.0, 31.5, 29.0)], "image_id int, roi_id int, ax double, ay double, bx double, by double")
    assert [(r.along, r.across) for r in raster.roi_contains(pixel, segment, 6.0).collect()] == [(pytest.approx(10), pytest.approx(-6))]
