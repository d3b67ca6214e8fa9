"""Edges, quadrilaterals and segments: moment sums, fits, peaks, runs and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from acutance.session import materialise, ship_package


def angle_histogram(dirs: DataFrame, keys: list[str], theta: str = "theta", bins: int = 72) -> DataFrame:
    """Q-1: directions (-pi .. pi) in circular bins."""
    b = F.least(F.rint(bins * (F.col(theta) + math.pi) / (2 * math.pi)).cast("int"), F.lit(bins - 1))
    return dirs.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def circular_peaks(h: DataFrame, keys: list[str], n: int = 4, bins: int = 72) -> DataFrame:
    """Q-2: bins that none of their neighbours at -3 .. +2 (round the circle) exceeds, the n largest of each key. Ties go to the larger bin."""
    score = F.col("n") * bins + F.col("bin")
    near = h.withColumn("score", score).withColumn("d", F.explode(F.sequence(F.lit(-3), F.lit(2)))).select(*keys, F.pmod(F.col("bin") - F.col("d"), F.lit(bins)).alias("bin"), F.col("score").alias("other"))
    best = near.groupBy(*keys, "bin").agg(F.max("other").alias("best"))
    peaks = h.withColumn("score", score).join(best, [*keys, "bin"]).where("score = best")
    w = W.partitionBy(*keys).orderBy(F.desc("score"))
    return peaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "bin", "n", "rank")


def weighted_moments(pts: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """The sum of weights, the weighted mean and the central second moments of points x, y: keys, s0, cx, cy, vxx, vxy, vyy."""
    s = lambda e: F.sum(F.col(weight) * e)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = pts.groupBy(*keys).agg(F.sum(weight).cast("double").alias("s0"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(x * y).alias("sxy"), s(y * y).alias("syy"))
    cx, cy = F.col("sx") / F.col("s0"), F.col("sy") / F.col("s0")
    return m.select(*keys, "s0", cx.alias("cx"), cy.alias("cy"), (F.col("sxx") / F.col("s0") - cx * cx).alias("vxx"), (F.col("sxy") / F.col("s0") - cx * cy).alias("vxy"), (F.col("syy") / F.col("s0") - cy * cy).alias("vyy"))


def principal_axes() -> tuple[Column, Column, Column]:
    """Larger and smaller variance and direction of the larger one, of columns vxx, vxy, vyy."""
    half, root = (F.col("vxx") + F.col("vyy")) / 2, F.sqrt(((F.col("vxx") - F.col("vyy")) / 2) ** 2 + F.col("vxy") ** 2)
    return half + root, half - root, F.atan2(2 * F.col("vxy"), F.col("vxx") - F.col("vyy")) / 2


def weighted_pca(pts: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Q-5: weighted centroid, axis lengths and direction of the principal axis, from moment sums about the first mean."""
    major, minor, angle = principal_axes()
    return weighted_moments(pts, keys, weight).select(*keys, "cx", "cy", major.alias("major"), minor.alias("minor"), angle.alias("angle"))


def cramer3(s: list[Column], t: list[Column]) -> tuple[Column, Column, Column]:
    """The solution a, b, c of the normal equations of y = a x^2 + b x + c; s[k] = sum x^k, t[k] = sum x^k y."""
    s0, s1, s2, s3, s4 = s
    det = s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = t[2] * (s2 * s0 - s1 * s1) - s3 * (t[1] * s0 - s1 * t[0]) + s2 * (t[1] * s1 - s2 * t[0])
    b = s4 * (t[1] * s0 - t[0] * s1) - t[2] * (s3 * s0 - s1 * s2) + s2 * (s3 * t[0] - s2 * t[1])
    c = s4 * (s2 * t[0] - s1 * t[1]) - s3 * (s3 * t[0] - s2 * t[1]) + t[2] * (s3 * s1 - s2 * s2)
    return a / det, b / det, c / det


def quadratic_fit(pts: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Q-6: a least-squares parabola from moment sums."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    sums = pts.groupBy(*keys).agg(*[F.sum(F.pow(xd, float(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(xd, float(k)) * yd).alias(f"t{k}") for k in range(3)])
    a, b, c = cramer3([F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)])
    return sums.where("s0 >= 3").select(*keys, a.alias("a"), b.alias("b"), c.alias("c"))


def corners(edges: DataFrame, keys: list[str], parallel: float = 0.866) -> DataFrame:
    """Q-8: intersections of the edge lines of a block (edge k through cx, cy with direction angle in radians), near-parallel pairs left out;
    the four nearest to the block's centre, clockwise."""
    side = lambda n: edges.select(*keys, F.col("k").alias(f"k{n}"), F.col("cx").alias(f"x{n}"), F.col("cy").alias(f"y{n}"), F.cos("angle").alias(f"c{n}"), F.sin("angle").alias(f"s{n}"))
    centre = edges.groupBy(*keys).agg(F.avg("cx").alias("bx"), F.avg("cy").alias("by_"))
    j = side(1).join(side(2), keys).where("k1 < k2").where(F.abs(F.col("c1") * F.col("c2") + F.col("s1") * F.col("s2")) < parallel)
    det = F.col("c1") * F.col("s2") - F.col("s1") * F.col("c2")
    t = ((F.col("x2") - F.col("x1")) * F.col("s2") - (F.col("y2") - F.col("y1")) * F.col("c2")) / det
    j = j.withColumn("x", F.col("x1") + t * F.col("c1")).withColumn("y", F.col("y1") + t * F.col("s1")).join(centre, keys)
    d = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by_")) ** 2
    near = j.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.round(d, 6), "k1", "k2"))).where("rank <= 4")
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(F.round(-F.atan2(F.col("y") - F.col("by_"), F.col("x") - F.col("bx")), 9), "k1", "k2"))
    return near.select(*keys, "k1", "k2", "x", "y", turn.alias("corner"))


def quad_area(corner_rows: DataFrame, keys: list[str], min_side: float = 14.0, min_area: float = 225.0) -> DataFrame:
    """Q-9: shortest side and area of each quadrilateral and whether it is large enough."""
    nxt = corner_rows.select(*keys, (F.when(F.col("corner") == 1, 4).otherwise(F.col("corner") - 1)).alias("corner"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    j = corner_rows.join(nxt, [*keys, "corner"])
    g = j.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)).alias("min_side"), (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"))
    return g.where("n = 4").select(*keys, "min_side", "area", ((F.col("min_side") > min_side) & (F.col("area") > min_area)).alias("ok"))


def pool_edges(edges: DataFrame, keys: list[str], cos_min: float = 0.80902, z_max: float = 1.66) -> DataFrame:
    """Q-14: of the pairs of a block's edges that are nearly parallel and agree in slope, greedily the most parallel first, each edge once.

    Slopes m with standard errors se agree if they differ by less than z_max errors; beyond 2 their inverses are compared.
    """
    side = lambda n: edges.select(*keys, F.col("k").alias(f"k{n}"), F.col("angle").alias(f"a{n}"), F.col("slope").alias(f"m{n}"), F.col("se").alias(f"e{n}"))
    m1, m2 = F.col("m1"), F.col("m2")
    z = F.abs(F.when(F.abs(m1) > 2, 1 / m1 - 1 / F.nullif(m2, F.lit(0.0))).otherwise(m1 - m2)) / F.sqrt(F.col("e1") ** 2 + F.col("e2") ** 2)
    alike = F.abs(F.cos(F.col("a1") - F.col("a2")))
    p = side(1).join(side(2), keys).where("k1 < k2").withColumn("z", z).withColumn("off", F.round(1 - alike, 9)).where((alike > cos_min) & (F.col("z") < z_max))
    first = F.row_number().over(W.partitionBy(*keys).orderBy("off", "k1", "k2"))
    p = p.withColumn("r", first)
    best = p.where("r = 1").select(*keys, F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    # Four edges make two pairs at most: the best one, and the best of those without its edges.
    rest = p.join(best, keys).where("k1 <> b1 and k1 <> b2 and k2 <> b1 and k2 <> b2")
    rest = rest.withColumn("r2", first).where("r2 = 1").select(*keys, "k1", "k2", "z")
    return p.where("r = 1").select(*keys, "k1", "k2", "z").unionByName(rest)


def pool_angles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Q-14: the angle of each edge (k, angle, and the moments s0, vxx, vxy, vyy of its points), shared by the edges of a pooled pair.

    The points of a pair, each edge's about its own centre, have the sums of both moments; their principal axis is the angle of both.
    Returns keys, k, angle, pooled.
    """
    major, minor, _ = principal_axes()
    known = edges.select(*keys, "k", "angle", "s0", "vxx", "vxy", "vyy")
    rated = known.withColumn("slope", F.tan("angle")).withColumn("se", F.sqrt(F.greatest(minor, F.lit(0.0)) / major / F.col("s0")))
    pairs = pool_edges(rated, keys)
    both = pairs.select(*keys, F.col("k1").alias("k"), F.col("k2").alias("o")).unionByName(pairs.select(*keys, F.col("k2").alias("k"), F.col("k1").alias("o")))
    other = known.select(*keys, F.col("k").alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("s0", "vxx", "vxy", "vyy")])
    j = known.join(both, [*keys, "k"], "left").join(other, [*keys, "o"], "left")
    sums = {c: F.col("s0") * F.col(c) + F.col("o_s0") * F.col(f"o_{c}") for c in ("vxx", "vxy", "vyy")}
    axis = F.atan2(2 * sums["vxy"], sums["vxx"] - sums["vyy"]) / 2
    turned = F.col("angle") + F.pmod(axis - F.col("angle") + math.pi / 2, F.lit(math.pi)) - math.pi / 2  # the axis has no sense; keep the edge's
    return j.select(*keys, "k", F.when(F.col("o").isNull(), F.col("angle")).otherwise(turned).alias("angle"), F.col("o").isNotNull().alias("pooled"))


def snap_angle(edges: DataFrame, a: float) -> DataFrame:
    """Q-16: each angle (degrees) replaced by the nearest of +-a, 90 +- a, -90 +- a and 180 +- a."""
    options = [a, -a, 90 + a, 90 - a, -90 + a, -90 - a, 180 + a, 180 - a]
    scored = F.array(*[F.struct(F.round(F.cos(F.radians(F.col("angle") - o)), 12).alias("c"), F.lit(-float(i)).alias("i"), F.lit(float(o)).alias("o")) for i, o in enumerate(options)])
    return edges.withColumn("angle", F.array_max(scored).getField("o"))


def block_sides(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Q-18: centroid of each block and which of its edges is top, bottom, left and right."""
    pick = lambda f, v: f(F.struct(F.col(v), F.col("k"))).getField("k")
    return edges.groupBy(*keys).agg(F.avg("cx").alias("bx"), F.avg("cy").alias("by_"), pick(F.min, "cy").alias("top"), pick(F.max, "cy").alias("bottom"), pick(F.min, "cx").alias("left"), pick(F.max, "cx").alias("right"))


def geometric_length(edges: DataFrame, corner_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Q-20: the distance between the two corners nearest to the edge's centroid."""
    j = edges.join(corner_rows.select(*keys, "corner", F.col("x").alias("qx"), F.col("y").alias("qy")), keys)
    d = (F.col("qx") - F.col("cx")) ** 2 + (F.col("qy") - F.col("cy")) ** 2
    j = j.withColumn("r", F.row_number().over(W.partitionBy(*keys, "k").orderBy(F.round(d, 6), "corner"))).where("r <= 2")
    ends = j.groupBy(*keys, "k").agg(*[F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("qx", "qy")])
    return ends.select(*keys, "k", F.sqrt((F.col("qx1") - F.col("qx2")) ** 2 + (F.col("qy1") - F.col("qy2")) ** 2).alias("length"))


def line_deviation(ridge: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Q-22: rise, run and slope between the extreme fitted positions of a parabola along the ridge."""
    p = ridge.join(fit, keys).withColumn("p", F.round(F.col("a") * F.col("x") ** 2 + F.col("b") * F.col("x") + F.col("c"), 6))
    e = p.groupBy(*keys).agg(F.min(F.struct("p", "x")).alias("lo"), F.max(F.struct("p", "x")).alias("hi"))
    rise, run = F.col("hi.p") - F.col("lo.p"), F.abs(F.col("hi.x") - F.col("lo.x"))
    return e.select(*keys, rise.alias("rise"), run.alias("run"), F.when(run > 0, rise / run).otherwise(0.0).alias("slope"))


def sliding_windows(edges: DataFrame, keys: list[str], length: float = 40.0, step: float = 4.0, most: int | None = None) -> DataFrame:
    """Q-23: windows of this length every step pixels along an edge of the given lo .. hi; with most, as many at even distances, two at least."""
    n = F.floor((F.col("hi") - F.col("lo") - length) / step).cast("int") + 1
    e = edges.where(F.col("hi") - F.col("lo") >= length).withColumn("_n", n if most is None else F.greatest(F.lit(2), F.least(n, F.lit(most))))
    e = e.withColumn("step", F.lit(step) if most is None else (F.col("hi") - F.col("lo") - length) / (F.col("_n") - 1))
    w = e.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("lo") + F.col("window") * F.col("step")
    return w.select(*keys, "window", start.alias("w0"), (start + length).alias("w1"), "step")


def window_samples(windows: DataFrame, samples: DataFrame, keys: list[str], length: float = 40.0) -> DataFrame:
    """Q-24 (first part): the samples of each window, by the windows that a position lies in, as an equi join. Other columns of samples stay."""
    lo = windows.groupBy(*keys).agg(F.min("w0").alias("_base"), F.max("window").alias("_most"), F.max("step").alias("_step"))
    s = samples.join(lo, keys)
    part = lambda off: (F.col("par") - F.col("_base") - off) / F.col("_step")
    still = F.col("_step") <= 0  # windows that all lie in one place
    first = F.when(still, 0).otherwise(F.greatest(F.lit(0), F.ceil(part(length)).cast("int")))
    last = F.when(still, F.col("_most")).otherwise(F.least(F.col("_most"), F.floor(part(0.0)).cast("int")))
    inside = (first <= last) & (F.col("par") >= F.col("_base"))
    return s.where(inside).withColumn("window", F.explode(F.sequence(first, last))).drop("_base", "_most", "_step")


def gradient_outliers(pix: DataFrame, keys: list[str], beyond: float = 2.0, share: float = 0.95, gap: float = 0.001) -> DataFrame:
    """Q-26: rows that are not at or above the 95 % rank of g2 in their half-pixel bin beyond 2 pixels; bins of 3 or fewer, or without a gap at the top, keep all."""
    b = F.floor(F.col("perp") * 2)
    w = W.partitionBy(*keys, "half_bin")
    r = pix.withColumn("half_bin", b).withColumn("rank", F.row_number().over(w.orderBy("g2", "perp", "par"))).withColumn("n", F.count("*").over(w)).withColumn("top", F.max("g2").over(w))
    second = F.max(F.when(F.col("rank") == F.col("n") - 1, F.col("g2"))).over(w)
    bad = (F.abs("perp") > beyond) & (F.col("n") > 3) & (F.col("top") - second >= gap) & (F.col("rank") > F.floor(F.col("n") * share))
    return r.withColumn("bad", bad).where("not bad").select(*pix.columns)


# Segmentation


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs of object pixels: image_id, y, x0, x1 and an id made of them."""
    island = F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x"))
    r = mask.withColumn("_i", island).groupBy("image_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")
    return r.withColumn("run", F.col("y").cast("long") * (1 << 32) + F.col("x0"))


def _settled(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is linked to: roots hook to smaller roots and paths are cut short until no link joins two roots."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (in the order of y, x0) of which one touches the other from the row above."""
    width = int(x1.max(initial=0)) + 2 * reach + 3
    above = (y - 1) * width
    first = np.searchsorted(y * width + x1, above + x0 - reach, "left")
    end = np.maximum(np.searchsorted(y * width + x0, above + x1 + reach, "right"), first)
    n = end - first
    return np.repeat(np.arange(len(y)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def connected_components(run_rows: DataFrame, reach: int = 1, band_rows: int = 256, fan: int = 64) -> DataFrame:
    """8-connected (reach 1) or 4-connected (reach 0) objects: each run with the smallest run id of its object.

    A picture is cut into bands of band_rows rows. A task labels the runs of a band, at most band_rows * width / 2 of them. Only labels
    that meet at a border between bands go on: the borders inside fan neighbouring bands are settled together, at most
    fan * width / 2 links, then those inside fan * fan bands, and so on, so there are as many steps as the tallest picture needs by its
    height alone, whatever its objects look like, and none where each picture is one band. Steps move only labels that change.
    """
    spark = run_rows.sparkSession
    ship_package(spark)
    rows = run_rows.select("image_id", "y", "x0", "x1", "run")
    image_type, names = rows.schema["image_id"], ["image_id", "y", "x0", "x1", "run", "label"]

    def label_band(group: pa.Table) -> pa.Table:
        group = group.sort_by([("y", "ascending"), ("x0", "ascending")]).combine_chunks()
        y, x0, x1, run = (group[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "run"))
        a, b = _touching(y - y.min(initial=0), x0, x1, reach)
        own = run[_settled(a, b, len(run))] if len(run) else run  # runs are in the order of their ids
        return group.select(names[:-1]).append_column("label", pa.array(own))

    banded = rows.withColumn("_band", F.floor(F.col("y") / band_rows))
    labelled = banded.groupBy("image_id", "_band").applyInArrow(label_band, rows.schema.add("label", "long"))
    labelled = materialise(labelled, "run-labels")
    tallest = labelled.agg(F.max(F.floor(F.col("y") / band_rows))).first()[0] or 0
    if not tallest:
        return labelled
    upper = labelled.where(F.pmod(F.col("y"), F.lit(band_rows)) == band_rows - 1).select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("b"))
    lower = labelled.where(F.pmod(F.col("y"), F.lit(band_rows)) == 0).select("image_id", "y", "x0", "x1", F.col("label").alias("a"))
    near = (F.col("x0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("x1") + reach)
    links = lower.join(upper, ["image_id", "y"]).where(near).select("image_id", F.floor(F.col("y") / band_rows).alias("border"), "a", "b").distinct()
    links = materialise(links, "border-links")

    def settle(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, at = np.unique(np.concatenate((group["a"].to_numpy(), group["b"].to_numpy())), return_inverse=True)
        root = nodes[_settled(at[: len(group)], at[len(group) :], len(nodes))]
        moved = root != nodes
        image = pa.array([group["image_id"][0].as_py()] * int(moved.sum()), group["image_id"].type)
        return pa.table({"image_id": image, "old": nodes[moved], "new": root[moved]})

    span = 1
    while span <= tallest:
        span *= fan
        inside = F.floor((F.col("border") - 1) / span) == F.floor(F.col("border") / span)  # both bands beside the border are in one group
        group = links.where(inside).withColumn("_group", F.floor(F.col("border") / span))
        moved = materialise(group.groupBy("image_id", "_group").applyInArrow(settle, T.StructType([image_type]).add("old", "long").add("new", "long")), "moved-labels")
        labelled = _relabelled(labelled, moved, "label")
        links = materialise(_relabelled(_relabelled(links.where(~inside), moved, "a"), moved, "b").distinct(), "border-links")
    return labelled.select(names)


def _relabelled(df: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    new = moved.select("image_id", F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(new, ["image_id", column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(df.columns)


def component_pixels(labelled: DataFrame) -> DataFrame:
    """Pixels with their label, the least (y, x) of the object as one number."""
    return labelled.withColumn("x", F.explode(F.sequence("x0", "x1"))).select("image_id", "label", "y", "x")


def boundaries(comps: DataFrame) -> DataFrame:
    """Object pixels with a 4-neighbour that isn't in the object."""
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    near = comps.withColumn("o", F.explode(four)).select("image_id", "label", "y", "x", (F.col("y") + F.col("o.a")).alias("ny"), (F.col("x") + F.col("o.b")).alias("nx"))
    own = comps.select("image_id", "label", F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(own, ["image_id", "label", "ny", "nx"], "left_anti").select("image_id", "label", "y", "x").distinct()


def filter_by_boundary(b: DataFrame, images: DataFrame, lo: int = 60, hi: int = 8000, share: float = 0.8) -> DataFrame:
    """C4: boundaries of labels with lo pixels to hi, or to that share of width and height where it is more; images: image_id, width, height."""
    n = b.groupBy("image_id", "label").agg(F.count("*").alias("n")).join(images.select("image_id", "width", "height"), "image_id")
    most = F.greatest(F.lit(float(hi)), share * (F.col("width") + F.col("height")))
    keep = n.where((F.col("n") >= lo) & (F.col("n") <= most)).select("image_id", "label")
    return b.join(keep, ["image_id", "label"], "left_semi")


def component_centroid(b: DataFrame) -> DataFrame:
    """The mean boundary point of each label."""
    return b.groupBy("image_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def inflate_boundaries(b: DataFrame, r: float, least: int = 40) -> DataFrame:
    """Boundary points moved outwards from the centroid by r pixels, for labels of more than least points."""
    j = b.join(component_centroid(b), ["image_id", "label"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    big = F.col("n") > least
    return j.select("image_id", "label", F.when(big, F.rint(F.col("y") + r * dy / d)).otherwise(F.col("y")).cast("int").alias("y"), F.when(big, F.rint(F.col("x") + r * dx / d)).otherwise(F.col("x")).cast("int").alias("x"))


def reject_frame_touching(b: DataFrame, images: DataFrame, margin: int = 4) -> DataFrame:
    """Boundaries of labels without a point within margin of the frame."""
    near = (F.col("x") <= margin) | (F.col("y") <= margin) | (F.col("x") >= F.col("width") - 1 - margin) | (F.col("y") >= F.col("height") - 1 - margin)
    bad = b.join(images, "image_id").where(near).select("image_id", "label").distinct()
    return b.join(bad, ["image_id", "label"], "left_anti")


# Sampling


def roi_rows(pix: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the last column of each row."""
    return pix.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))


def edge_pixels(px: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All pixels of the row spans: a span is exploded, so the join is on equal keys."""
    spans = rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).select("image_id", *keys, "y", "x")
    return spans.join(px, ["image_id", "y", "x"])


def sample_line(ep: DataFrame, edges: DataFrame, keys: list[str], across: float = 28.0, along: float = 1e9) -> DataFrame:
    """Distance to the line and position along it."""
    j = ep.join(edges, keys)
    dx, dy, c, s = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.cos("angle"), F.sin("angle")
    out = j.select(*keys, (dy * c - dx * s).alias("perp"), (dx * c + dy * s).alias("par"), "v")
    return out.where((F.abs("perp") < across) & (F.abs("par") < along))


def parabola_distance(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """df(x, y, ...) with perp and par: signed distance to y = a x^2 + b x + c and the nearest point's x, by the real roots of a cubic."""
    a, b, c = F.col(a), F.col(b), F.col(c)
    # 2 a^2 t^3 + 3 a b t^2 + (b^2 + 2 a (c - y) + 1) t + b (c - y) - x = 0; where a is 0 it is linear.
    k = c - F.col("y")
    flat = F.abs(a) < 1e-9
    p3, p2, p1, p0 = F.when(flat, 1.0).otherwise(2 * a * a), 3 * a * b, b * b + 2 * a * k + 1, b * k - F.col("x")
    B, C, D = p2 / p3, p1 / p3, p0 / p3
    p, q = C - B * B / 3, 2 * B * B * B / 27 - B * C / 3 + D
    disc = q * q / 4 + p * p * p / 27
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    one = F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root) - B / 3
    r = F.sqrt(F.greatest(-p / 3, F.lit(1e-300)))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 3 * q / F.nullif(2 * p * r, F.lit(0.0))))) / 3
    three = [2 * r * F.cos(phi - 2 * math.pi * n / 3) - B / 3 for n in range(3)]
    roots = F.when(flat, F.array(-p0 / (b * b + 1))).when(disc > 0, F.array(one)).otherwise(F.array(*three))
    at = F.transform(roots, lambda t: F.struct(((t - F.col("x")) ** 2 + (a * t * t + b * t + c - F.col("y")) ** 2).alias("d2"), t.alias("t")))
    near = F.array_min(at)
    sign = F.when(F.col("y") >= a * F.col("x") ** 2 + b * F.col("x") + c, 1.0).otherwise(-1.0)
    return df.withColumn("perp", sign * F.sqrt(near["d2"])).withColumn("par", near["t"])


def sample_quadratic(ep: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Signed distance to the parabola y = a x^2 + b x + c, and the place along it."""
    return parabola_distance(ep.join(fits, keys), "a", "b", "c").select(*keys, "y", "x", "v", "perp", "par")


def edge_length(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The extent along the edge."""
    return samples.groupBy(*keys).agg((F.max("par") - F.min("par")).alias("length"))


def min_samples(samples: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Samples of edges that have enough of them, by a count that is joined."""
    keep = samples.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return samples.join(keep, keys, "left_semi")


def reposition(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Q-11: corners of the refined edges and outward normals: away from the block's centre."""
    c = edges.groupBy(*keys).agg(F.avg("cx").alias("bx"), F.avg("cy").alias("by_"))
    j = edges.join(c, keys).withColumn("nx", -F.sin("angle")).withColumn("ny", F.cos("angle"))
    out = (F.col("cx") - F.col("bx")) * F.col("nx") + (F.col("cy") - F.col("by_")) * F.col("ny") < 0
    return j.select(*keys, "k", F.when(out, -F.col("nx")).otherwise(F.col("nx")).alias("nx"), F.when(out, -F.col("ny")).otherwise(F.col("ny")).alias("ny"))


def recentre(edges: DataFrame, refined: DataFrame, keys: list[str], again, tol: float = 1.0) -> DataFrame:
    """Q-15: edges whose centre moved by more than tol are measured again by again(rows); the others keep their refinement."""
    o = edges.select(*keys, F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    j = refined.join(o, keys).withColumn("moved", F.sqrt((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2) > tol).drop("ox", "oy")
    return j.where("not moved").drop("moved").unionByName(again(j.where("moved").drop("moved")))


def pair_edges_with_corners(edges: DataFrame, corner_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Q-19: for each corner, clockwise from twelve o'clock, the edge nearest to the line to the next corner."""
    c = corner_rows.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    turn = F.round(F.pmod(F.atan2(F.col("x") - F.col("mx"), F.col("my") - F.col("y")), F.lit(2 * math.pi)), 9)
    o = corner_rows.join(c, keys).withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(turn, "corner")))
    nxt = o.select(*keys, F.when(F.col("n") == 1, 4).otherwise(F.col("n") - 1).alias("n"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seg = o.join(nxt, [*keys, "n"])
    mid = (F.col("cx") - (F.col("x") + F.col("x2")) / 2) ** 2 + (F.col("cy") - (F.col("y") + F.col("y2")) / 2) ** 2
    j = seg.join(edges.select(*keys, "k", "cx", "cy"), keys)
    best = F.min(F.struct(F.round(mid, 6).alias("d"), "k")).getField("k")
    return j.groupBy(*keys, "n", "x", "y").agg(best.alias("k"))


def roi_measure_prep(px: DataFrame, rois: DataFrame, half_width: float = 28.0) -> DataFrame:
    """Q-25: each region as one edge: pixels near the segment, a first line by the gradient along it, pixels that contaminate it left out, a second line."""
    from acutance.operators import raster

    keys = ["image_id", "roi_id"]
    g = raster.gradients(px).select("image_id", "y", "x", "g2")
    pix = raster.roi_contains(px, rois, half_width).join(g, ["image_id", "y", "x"])
    clean = gradient_outliers(pix.select(*keys, "x", "y", F.col("across").alias("perp"), F.col("along").alias("par"), "g2"), keys)
    return weighted_pca(clean.where("g2 > 0").withColumn("w", F.col("g2")), keys)
