"""Chart coordinates, fiducials and focus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.session import broadcast_if_small


def dedupe_fiducials(f: DataFrame) -> DataFrame:
    """K6: of two fiducials closer than the smaller minor axis, the larger stays (of equals the smaller id). Filed by tiles as wide as an image's largest minor axis."""
    wide = f.groupBy("image_id").agg(F.greatest(F.max("minor"), F.lit(1.0)).alias("tile"))
    f = f.join(wide, "image_id").withColumn("ty", F.floor(F.col("cy") / F.col("tile"))).withColumn("tx", F.floor(F.col("cx") / F.col("tile")))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    o = f.withColumn("ty", F.explode(F.transform(around, lambda a: F.col("ty") + a))).withColumn("tx", F.explode(F.transform(around, lambda a: F.col("tx") + a)))
    o = o.select("image_id", "ty", "tx", F.col("fid").alias("ofid"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("minor").alias("om"), F.col("major").alias("o_major"))
    near = F.sqrt((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2) < F.least("minor", "om")
    larger = (F.col("o_major") > F.col("major")) | ((F.col("o_major") == F.col("major")) & (F.col("ofid") < F.col("fid")))
    bad = f.join(o, ["image_id", "ty", "tx"]).where((F.col("fid") != F.col("ofid")) & near & larger).select("image_id", "fid").distinct()
    return f.join(bad, ["image_id", "fid"], "left_anti").drop("tile", "ty", "tx")


def edit_distance4(a: Column, b: Column) -> Column:
    """K7: insert/delete distance of two arrays of four codes: 8 - 2 LCS, unrolled; a substitution costs 2."""
    row = [F.lit(0)] * 5
    for i in range(1, 5):
        new = [F.lit(0)]
        for j in range(1, 5):
            same = (F.element_at(a, i) == F.element_at(b, j)).cast("int")
            new.append(F.greatest(row[j], new[j - 1], row[j - 1] + same))
        row = new
    return 8 - 2 * row[4]


def match_code_set(f: DataFrame, sets: DataFrame) -> DataFrame:
    """K7: sorted codes of the four fiducials nearest to each image's origin, and the set (set_id, codes) nearest by edit distance. The sets are a short fixed list."""
    d = F.round(F.col("cx") ** 2 + F.col("cy") ** 2, 6)
    four = f.withColumn("r", F.row_number().over(W.partitionBy("image_id").orderBy(d, "fid"))).where("r <= 4")
    own = four.groupBy("image_id").agg(F.sort_array(F.collect_list("code")).alias("own")).where(F.size("own") == 4)
    j = own.join(broadcast_if_small(sets)).withColumn("d", edit_distance4(F.col("own"), F.col("codes")))
    return j.groupBy("image_id").agg(F.min(F.struct("d", "set_id")).alias("b")).select("image_id", F.col("b.set_id").alias("set_id"), F.col("b.d").alias("distance"))


def chart_axes(f: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """K8: origin midway between the two fiducials of code 0 and the unit vector along them.

    orders (image_id, codes: the four inner codes of the image's set in chart order) gives the vector its sign: of those codes the first that the image has lies ahead of the
    origin if it is one of the first two, behind it if not (of fiducials that share a code the last counts). Without orders, or without such a fiducial, the vector goes from the first zero to the last.
    """
    z = f.where("code = 0").groupBy("image_id").agg(F.avg("cx").alias("ox"), F.avg("cy").alias("oy"), F.min(F.struct("fid", "cx", "cy")).alias("a"), F.max(F.struct("fid", "cx", "cy")).alias("b"), F.count("*").alias("n")).where("n = 2")
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    n = F.sqrt(dx * dx + dy * dy)
    axes = z.where(n > 0).select("image_id", "ox", "oy", (dx / n).alias("tx"), (dy / n).alias("ty"))
    if orders is None:
        return axes
    place = orders.select("image_id", F.posexplode("codes").alias("_i", "code")).where("_i < 4")
    last = f.where("code > 0").groupBy("image_id", "code").agg(F.max(F.struct("fid", "cx", "cy")).alias("_f"))
    first = place.join(last, ["image_id", "code"]).groupBy("image_id").agg(F.min(F.struct("_i", F.col("_f.cx").alias("cx"), F.col("_f.cy").alias("cy"))).alias("_g"))
    j = axes.join(first, "image_id", "left")
    ahead = (F.col("_g.cx") - F.col("ox")) * F.col("tx") + (F.col("_g.cy") - F.col("oy")) * F.col("ty")
    turn = F.when(F.when(F.col("_g._i") < 2, ahead).otherwise(-ahead) < 0, -1.0).otherwise(1.0)
    return j.select("image_id", "ox", "oy", (F.col("tx") * turn).alias("tx"), (F.col("ty") * turn).alias("ty"))


def correspondences(f: DataFrame, layout: DataFrame, scale: float = 1.0) -> DataFrame:
    """K9: image points with their chart places in mm, by code."""
    return f.where("code > 0").join(layout, "code").select("image_id", "fid", "cx", "cy", (F.col("x_mm") * scale).alias("x_mm"), (F.col("y_mm") * scale).alias("y_mm"))


def chart_to_image(pts: DataFrame, poses: DataFrame) -> DataFrame:
    """Chart points (plane z = 0) through the pose and the radial term to the image."""
    j = pts.join(poses, "image_id")
    r = lambda i: F.col("r")[i]
    t = lambda i: F.col("t")[i]
    c = [r(3 * i) * F.col("x_mm") + r(3 * i + 1) * F.col("y_mm") + t(i) for i in range(3)]
    u, v = c[0] / c[2], c[1] / c[2]
    k = 1 + F.col("k1") * (u * u + v * v)
    return j.withColumns({"px_x": F.col("f") * u * k + F.col("px"), "px_y": F.col("f") * v * k + F.col("py")})


def image_to_chart(pts: DataFrame, poses: DataFrame) -> DataFrame:
    """The radial term undone (the root of a cubic by eight fixed-point steps), then back onto the chart's plane."""
    j = pts.join(poses, "image_id")
    ud, vd = (F.col("ix") - F.col("px")) / F.col("f"), (F.col("iy") - F.col("py")) / F.col("f")
    j = j.withColumns({"ud": ud, "vd": vd, "s": F.lit(1.0)})
    for _ in range(8):
        j = j.withColumn("s", 1 / (1 + F.col("k1") * (F.col("ud") ** 2 + F.col("vd") ** 2) * F.col("s") ** 2))
    u, v = F.col("ud") * F.col("s"), F.col("vd") * F.col("s")
    r = lambda i: F.col("r")[i]
    t = lambda i: F.col("t")[i]
    a11, a12, b1 = r(0) - u * r(6), r(1) - u * r(7), u * t(2) - t(0)
    a21, a22, b2 = r(3) - v * r(6), r(4) - v * r(7), v * t(2) - t(1)
    det = a11 * a22 - a12 * a21
    return j.withColumns({"x_mm": (b1 * a22 - a12 * b2) / det, "y_mm": (a11 * b2 - b1 * a21) / det}).drop("ud", "vd", "s")


def depth(pts: DataFrame, poses: DataFrame) -> DataFrame:
    """Camera distance of chart points less that of the chart's centre."""
    j = pts.join(poses, "image_id")
    return j.withColumn("depth", F.col("r")[6] * F.col("x_mm") + F.col("r")[7] * F.col("y_mm") + F.col("t")[2] - F.col("centre_depth"))


def chart_angles(poses: DataFrame) -> DataFrame:
    """Roll, yaw and pitch in degrees."""
    r = lambda i: F.col("r")[i]
    return poses.select("image_id", F.degrees(F.atan2(r(3), r(0))).alias("roll"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r(6))))).alias("yaw"), F.degrees(F.atan2(r(7), r(8))).alias("pitch"))


def reprojection_rmse(corr: DataFrame, poses: DataFrame, most: float = 1.5) -> DataFrame:
    """Root mean square of the image error of each capture, and whether it is above most pixels."""
    e = chart_to_image(corr, poses)
    rms = F.sqrt(F.avg((F.col("px_x") - F.col("cx")) ** 2 + (F.col("px_y") - F.col("cy")) ** 2))
    return e.groupBy("image_id").agg(rms.alias("rmse")).withColumn("poor", F.col("rmse") > most)


def focus_samples(ps: DataFrame, poses: DataFrame, half_x: float = 20.0, half_y: float = 180.0) -> DataFrame:
    """Samples of quality above 0.2 near the chart's axis, with their depth."""
    near = ps.where((F.col("quality") > 0.2) & (F.abs("x_mm") <= half_x) & (F.abs("y_mm") <= half_y))
    return depth(near, poses).select("image_id", "depth", "mtf", "quality")


#: The 9-tap smoothing weights of a parabola.
SG9 = [x / 231 for x in (-21, 14, 39, 54, 59, 54, 39, 14, -21)]


def sg_outliers(ps: DataFrame, keys: list[str], x: str, y: str, tol: float = 0.04) -> DataFrame:
    """Samples within tol of the nine-tap smoothing in the order of x; where fewer than nine are near, all stay."""
    w = W.partitionBy(*keys).orderBy(x, y)
    at = lambda d: F.lag(y, -d).over(w) if d < 0 else (F.col(y) if d == 0 else F.lead(y, d).over(w))
    smooth = sum((SG9[d + 4] * at(d) for d in range(-4, 5)), F.lit(0.0))
    return ps.withColumn("_s", smooth).where(F.col("_s").isNull() | (F.abs(F.col(y) - F.col("_s")) <= tol * F.abs("_s"))).drop("_s")


def curve_peak(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The peak of a densely evaluated curve: a parabola through the largest value and its neighbours."""
    w = W.partitionBy(*keys).orderBy(x)
    n = points.withColumns({"yl": F.lag(y).over(w), "yr": F.lead(y).over(w), "xl": F.lag(x).over(w), "xr": F.lead(x).over(w)})
    top = n.groupBy(*keys).agg(F.max(F.struct(F.col(y).alias("y"), (-F.col(x)).alias("nx"), "yl", "yr", "xl", "xr")).alias("b"))
    h = (F.col("b.xr") - F.col("b.xl")) / 2
    bend = F.col("b.yl") - 2 * F.col("b.y") + F.col("b.yr")
    shift = F.when(bend < 0, h * (F.col("b.yl") - F.col("b.yr")) / (2 * bend)).otherwise(0.0)
    return top.select(*keys, (-F.col("b.nx") + F.coalesce(shift, F.lit(0.0))).alias("peak"), F.col("b.y").alias("top"))


def focal_ratio(props: DataFrame) -> DataFrame:
    """Focal length over sensor width from a map of camera properties: the 35 mm equivalent over 36; else by the diagonal and an aspect `a:b`;
    else by pixels and resolution; -1 if unknown."""
    get = lambda k: F.expr(f"try_cast(element_at(props, '{k}') as double)")
    a = F.expr("try_cast(split(element_at(props, 'aspect'), '[:/]')[0] as double)") / F.expr("try_cast(try_element_at(split(element_at(props, 'aspect'), '[:/]'), 2) as double)")
    first = get("focal35") / 36
    second = get("focal") / F.sqrt(get("diagonal") ** 2 / (1 + 1 / (a * a)))
    third = get("focal") / (25.4 * get("pixels") / get("resolution"))
    return props.withColumn("focal_ratio", F.coalesce(first, second, third, F.lit(-1.0)))


def rotation(roll: float, yaw: float, pitch: float) -> list[float]:
    """A rotation matrix, row by row, from angles in degrees (tests and examples)."""
    a, b, c = (math.radians(v) for v in (roll, yaw, pitch))
    ca, sa, cb, sb, cc, sc = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    return [ca * cb, ca * sb * sc - sa * cc, ca * sb * cc + sa * sc, sa * cb, sa * sb * sc + ca * cc, sa * sb * cc - ca * sc, -sb, cb * sc, cb * cc]


def ellipse_precheck(b: DataFrame, images: DataFrame, tol: float = 0.25) -> DataFrame:
    """K1: axes of each contour from its covariance, and whether its length is within tol of an ellipse's (Ramanujan) and no point is on the frame.

    The contour's length is its number of points times the mean step of an eight-connected contour.
    """
    j = b.join(images, "image_id")
    frame = (F.col("x") <= 1) | (F.col("y") <= 1) | (F.col("x") >= F.col("width") - 2) | (F.col("y") >= F.col("height") - 2)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = j.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.var_pop(x).alias("vxx"), F.var_pop(y).alias("vyy"), F.covar_pop(x, y).alias("vxy"), F.max(frame.cast("int")).alias("frame"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    half, root = (F.col("vxx") + F.col("vyy")) / 2, F.sqrt(((F.col("vxx") - F.col("vyy")) / 2) ** 2 + F.col("vxy") ** 2)
    a, c = F.sqrt(2 * (half + root)), F.sqrt(F.greatest(F.lit(0.0), 2 * (half - root)))
    m = m.withColumn("a", a).withColumn("b", c)
    h = (F.col("a") - F.col("b")) ** 2 / F.nullif((F.col("a") + F.col("b")) ** 2, F.lit(0.0))
    around = math.pi * (F.col("a") + F.col("b")) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))
    ok = (F.col("frame") == 0) & (F.abs(F.col("n") * 1.11 / F.nullif(around, F.lit(0.0)) - 1) <= tol)
    return m.select("image_id", "label", "cx", "cy", F.col("a").alias("major"), F.col("b").alias("minor"), F.coalesce(ok, F.lit(False)).alias("ok"))


def fit_ellipse(pts: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """K2: a dual conic through weighted gradient lines: points x, y with gradient gx, gy; centre and half axes.

    A line of the contour's tangent is l = (gx, gy, -(gx x + gy y)); the dual conic C satisfies l' C l = 0 with its last element 1. Spark sums the
    fifteen and five moments; the 5 x 5 solve runs on batches of them, a row for each key.
    """
    import numpy as np

    p = "-(gx * (x - x0) + gy * (y - y0))"
    centre = pts.groupBy(*keys).agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"))
    t = pts.hint("merge").join(centre, keys).withColumn("p", F.expr(p))  # never broadcast: Spark doesn't count the rows of an explode
    u = [F.col("gx") ** 2, F.col("gx") * F.col("gy"), F.col("gy") ** 2, F.col("gx") * F.col("p"), F.col("gy") * F.col("p")]
    rhs = -F.col("p") ** 2
    sums = t.groupBy(*keys, "x0", "y0").agg(F.count("*").alias("n"), *[F.sum(F.col(weight) * u[i] * u[j]).alias(f"a{i}{j}") for i in range(5) for j in range(i, 5)], *[F.sum(F.col(weight) * u[i] * rhs).alias(f"b{i}") for i in range(5)]).where("n >= 6")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pts.select(*keys).schema.fields)

    def axes(m, v):
        s = np.linalg.lstsq(m, v, rcond=None)[0]
        dual = np.array([[s[0], s[1] / 2, s[3] / 2], [s[1] / 2, s[2], s[4] / 2], [s[3] / 2, s[4] / 2, 1.0]])
        cx, cy = dual[0, 2], dual[1, 2]
        shape = np.outer([cx, cy], [cx, cy]) - dual[:2, :2]
        values = np.sqrt(np.maximum(np.linalg.eigvalsh(shape), 0))
        return cx, cy, values[1], values[0]

    def solve(batches):  # a row of sums is a key
        for g in batches:
            a = np.array([[g[f"a{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)], float).reshape(5, 5, -1).transpose(2, 0, 1)
            b = np.array([g[f"b{i}"] for i in range(5)], float).T
            e = np.array([axes(m, v) for m, v in zip(a, b, strict=True)], float).reshape(-1, 4)
            yield g[keys].assign(cx=e[:, 0] + g["x0"], cy=e[:, 1] + g["y0"], major=e[:, 2], minor=e[:, 3])

    return sums.mapInPandas(solve, f"{fields}, cx double, cy double, major double, minor double")


def ellipse_gradient_check(pts: DataFrame, ellipses: DataFrame, keys: list[str], share: float = 0.9, limit: float = 20.0) -> DataFrame:
    """K3: whether the order statistic at 90 % of the angle (degrees) between gradient and normal of the ellipse (cx, cy, major, minor, angle) is below a limit."""
    from acutance.operators.reports import rank_pick

    j = pts.join(ellipses, keys)
    c, s = F.cos("angle"), F.sin("angle")
    u, v = (F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s, (F.col("y") - F.col("cy")) * c - (F.col("x") - F.col("cx")) * s
    nu, nv = u / F.col("major") ** 2, v / F.col("minor") ** 2
    nx, ny = nu * c - nv * s, nu * s + nv * c
    cos = F.abs(F.col("gx") * nx + F.col("gy") * ny) / F.greatest(F.sqrt((F.col("gx") ** 2 + F.col("gy") ** 2) * (nx**2 + ny**2)), F.lit(1e-12))
    d = j.select(*keys, F.round(F.degrees(F.acos(F.least(F.lit(1.0), cos))), 6).alias("off"))
    return rank_pick(d, keys, "off", [share]).select(*keys, F.col("value").alias("off"), (F.col("value") < limit).alias("ok"))


def decode_fiducial(px: DataFrame, ellipses: DataFrame) -> DataFrame:
    """K4: codes of ellipses (image_id, fid, cx, cy, major, minor, angle): Otsu's threshold inside, bright shares on the rings at 0.3 (30 places) and 0.5 (50);
    code = 4 rint(5 outer) + rint(3 inner); bright nowhere near the centre, or almost everywhere, is no fiducial.
    """
    from acutance.operators import raster

    c, s = F.cos("angle"), F.sin("angle")
    r = F.ceil("major").cast("int")
    inside = ellipses.withColumn("dy", F.explode(F.sequence(-r, r))).withColumn("dx", F.explode(F.sequence(-r, r)))
    inside = inside.select("image_id", "fid", "cx", "cy", "major", "minor", "angle", F.rint(F.col("cy") + F.col("dy")).cast("int").alias("y"), F.rint(F.col("cx") + F.col("dx")).cast("int").alias("x"))
    u, v = (F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s, (F.col("y") - F.col("cy")) * c - (F.col("x") - F.col("cx")) * s
    rho = F.sqrt((u / F.col("major")) ** 2 + (v / F.col("minor")) ** 2)
    p = inside.withColumn("rho", rho).where("rho <= 1").join(px, ["image_id", "y", "x"])
    h = p.groupBy("image_id", "fid", "v").agg(F.count("*").alias("n"))
    one = h.select(F.struct("image_id", "fid").alias("image_id"), "v", "n")
    t = raster.otsu(one).select("image_id.*", "threshold")
    bright = p.join(t, ["image_id", "fid"]).groupBy("image_id", "fid").agg(F.avg((F.col("v") > F.col("threshold")).cast("int")).alias("share"), F.max(F.when(F.col("rho") < 0.2, (F.col("v") > F.col("threshold")).cast("int"))).alias("core"), F.first("threshold").alias("threshold"))
    rings = F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(2 * math.pi * i / n)).alias("a")) for q, n in ((0.3, 30), (0.5, 50)) for i in range(n)])
    g = ellipses.withColumn("g", F.explode(rings))
    eu, ev = F.col("g.q") * F.col("major") * F.cos("g.a"), F.col("g.q") * F.col("minor") * F.sin("g.a")
    g = g.select("image_id", "fid", F.col("g.q").alias("q"), F.rint(F.col("cy") + eu * s + ev * c).cast("int").alias("y"), F.rint(F.col("cx") + eu * c - ev * s).cast("int").alias("x"))
    on = g.join(px, ["image_id", "y", "x"]).join(bright, ["image_id", "fid"])
    lit = (F.col("v") > F.col("threshold")).cast("int")
    code = on.groupBy("image_id", "fid").agg(F.avg(F.when(F.col("q") == 0.3, lit)).alias("inner"), F.avg(F.when(F.col("q") == 0.5, lit)).alias("outer"), F.first("share").alias("share"), F.first("core").alias("core"))
    return code.select("image_id", "fid", (4 * F.rint(5 * F.col("outer")) + F.rint(3 * F.col("inner"))).cast("int").alias("code"), ((F.col("core") == 1) & (F.col("share") < 0.9999)).alias("valid"))


def hole_near_centre(comps: DataFrame, ellipses: DataFrame, reach: int = 3) -> DataFrame:
    """K5: whether a pixel of another label lies within reach of each ellipse's centre; ellipses have image_id, label, cx, cy."""
    o = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    e = ellipses.select("image_id", F.col("label").alias("own"), "cx", "cy").withColumn("dy", o).withColumn("dx", o)
    e = e.select("image_id", "own", F.rint(F.col("cy") + F.col("dy")).cast("int").alias("y"), F.rint(F.col("cx") + F.col("dx")).cast("int").alias("x"))
    j = e.join(comps, ["image_id", "y", "x"], "left")
    return j.groupBy("image_id", F.col("own").alias("label")).agg(F.coalesce(F.bool_or(F.col("label") != F.col("own")), F.lit(False)).alias("hole"))


def largest_block_scale(blocks: DataFrame, width_mm: float = 62.0, ratio: float = 1.5) -> DataFrame:
    """Mm a pixel of each image from its largest block (block_id, area, cx, cy), if that is ratio times the next; and the share of blocks left of it."""
    w = W.partitionBy("image_id").orderBy(F.desc("area"), "block_id")
    b = blocks.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("area").over(w)).withColumn("side", F.percent_rank().over(W.partitionBy("image_id").orderBy("cx", "block_id")))
    return b.where("r = 1").select("image_id", "block_id", (width_mm / F.sqrt("area")).alias("mm_per_px"), "side", (F.col("next").isNull() | (F.col("area") >= ratio * F.col("next"))).alias("dominant"))


def focus_ridge(ps: DataFrame, keys: list[str], lines: list[float], reach: float = 15.0, width: float = 3.0, least: int = 42) -> DataFrame:
    """For each line y, the depth of the peak of a Gaussian-weighted parabola through the samples (y_mm, depth, mtf) near it.

    Lines are a fixed list; a sample is sent to the lines in its reach.
    """
    from acutance.operators.geometry import cramer3

    near = ps.withColumn("line", F.explode(F.array(*[F.lit(float(v)) for v in lines]))).where(F.abs(F.col("y_mm") - F.col("line")) < reach)
    w = F.exp(-((F.col("y_mm") - F.col("line")) ** 2) / (2 * width * width))
    near = near.withColumn("w", w)
    x = F.col("depth")
    sums = near.groupBy(*keys, "line").agg(F.count("*").alias("n"), F.min("depth").alias("x0"), F.max("depth").alias("x1"), *[F.sum(F.col("w") * F.pow(x, float(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.col("w") * F.pow(x, float(k)) * F.col("mtf")).alias(f"t{k}") for k in range(3)])
    sums = sums.where((F.col("n") >= least) & (F.col("x1") > F.col("x0")))
    a, b, _ = cramer3([F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)])
    return sums.withColumn("a", a).withColumn("b", b).where("a < 0").select(*keys, "line", (-F.col("b") / (2 * F.col("a"))).alias("peak"), "n")
