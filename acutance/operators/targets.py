"""Finding and refining target edges, robust lines, holes, and fits whose small solves run grouped."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.operators import geometry


def refine_peaks(dirs: DataFrame, peaks: DataFrame, keys: list[str], tol: float = 0.03 * 2 * math.pi, trim: float = 0.05, bins: int = 72) -> DataFrame:
    """Q-3: the trimmed mean of the directions within tol of each peak, on the circle."""
    p = peaks.select(*keys, "rank", (F.col("bin") * (2 * math.pi / bins) - math.pi).alias("at"))
    off = F.pmod(F.col("theta") - F.col("at") + math.pi, F.lit(2 * math.pi)) - math.pi
    near = dirs.join(p, keys).withColumn("off", off).where(F.abs("off") <= tol)
    w = W.partitionBy(*keys, "rank")
    r = near.withColumn("i", F.row_number().over(w.orderBy("off")) - 1).withColumn("n", F.count("*").over(w))
    cut = F.floor(F.col("n") * trim)
    inside = r.where((F.col("i") >= cut) & (F.col("i") < F.col("n") - cut))
    return inside.groupBy(*keys, "rank", "at").agg(F.avg("off").alias("m"), F.count("*").alias("n")).select(*keys, "rank", (F.col("at") + F.col("m")).alias("theta"), "n")


def assign_to_edges(pts: DataFrame, edges: DataFrame, keys: list[str], tol: float = 20.0) -> DataFrame:
    """Q-4: the nearest line of its block for each boundary point, and whether the point's direction agrees with it.

    Both sides may come out of an explode, whose rows Spark doesn't count, so neither is broadcast.
    """
    j = pts.join(edges.select(*keys, "k", "cx", "cy", "angle").hint("merge"), keys)
    d = F.abs((F.col("y") - F.col("cy")) * F.cos("angle") - (F.col("x") - F.col("cx")) * F.sin("angle"))
    agrees = F.abs(F.cos(F.col("theta") - F.col("angle"))) >= math.cos(math.radians(tol))
    best = F.min(F.struct(F.round(d, 6).alias("d"), "k", agrees.alias("agrees"))).alias("b")
    return j.groupBy(*keys, "y", "x").agg(best).select(*keys, "y", "x", F.col("b.k").alias("k"), F.col("b.d").alias("distance"), F.col("b.agrees").alias("agrees"))


def quad_validity(assigned: DataFrame, keys: list[str], mild: float = 1.0, severe: float = 3.0) -> DataFrame:
    """Q-7: blocks are refused with more than 1/8 points that agree with no edge, more than 10 % mild or 2 % severe deviations."""
    share = lambda c: F.count_if(c) / F.count("*")
    s = assigned.groupBy(*keys).agg(share(~F.col("agrees")).alias("outliers"), share(F.col("distance") > mild).alias("mild"), share(F.col("distance") > severe).alias("severe"))
    return s.withColumn("valid", (F.col("outliers") <= 1 / 8) & (F.col("mild") <= 0.1) & (F.col("severe") <= 0.02))


def edge_roi_boxes(edges: DataFrame, keys: list[str], width: float = 28.5) -> DataFrame:
    """Q-10: along and across limits of each edge's region: the ends are inset by 8 % of the length, 5 to 16 pixels."""
    inset = F.least(F.lit(16.0), F.greatest(F.lit(5.0), 0.08 * F.col("length")))
    return edges.select(*keys, "k", (inset - F.col("length") / 2).alias("along0"), (F.col("length") / 2 - inset).alias("along1"), F.lit(-width).alias("across0"), F.lit(width).alias("across1")).where("along0 < along1")


def homogeneous(edges: DataFrame, comps: DataFrame, keys: list[str], probes: int = 20, least: int = 15) -> DataFrame:
    """Q-12: whether along every edge's inward normal (nx, ny) enough of the probe pixels carry the block's label."""
    p = edges.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(probes))))
    p = p.select(*keys, "image_id", "k", "label", F.rint(F.col("cy") + F.col("i") * F.col("ny")).cast("int").alias("y"), F.rint(F.col("cx") + F.col("i") * F.col("nx")).cast("int").alias("x"))
    j = p.join(comps.withColumn("hit", F.lit(1)), ["image_id", "label", "y", "x"], "left")
    per = j.groupBy(*keys, "k").agg((F.count("hit") >= least).alias("ok"))
    return per.groupBy(*keys).agg(F.bool_and("ok").alias("homogeneous"))


def edge_refine(pix: DataFrame, keys: list[str]) -> DataFrame:
    """Q-13: pixels (perp, par, w) trimmed to the 10 .. 90 % limits of a spread histogram of weights across the edge, weighted anew by
    w^4 / (10 + |d|) relative to the largest weight, and fitted again."""
    c = F.floor(F.col("perp") * 8).cast("int")
    h = pix.select(*keys, F.explode(F.sequence(c - 3, c + 3)).alias("bin"), "w").groupBy(*keys, "bin").agg(F.sum("w").alias("w"))
    w = W.partitionBy(*keys)
    h = h.withColumn("share", F.sum("w").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(w))
    lim = h.groupBy(*keys).agg(F.max(F.when(F.round("share", 9) <= 0.1, F.col("bin"))).alias("lo"), F.min(F.when(F.round("share", 9) >= 0.9, F.col("bin"))).alias("hi"))
    j = pix.join(lim, keys).where(F.floor(F.col("perp") * 8).between(F.coalesce("lo", F.lit(-10**6)), F.coalesce("hi", F.lit(10**6))))
    top = j.groupBy(*keys).agg(F.max("w").alias("top"), F.count("*").alias("n")).where("n >= 20")
    j = j.join(top, keys).withColumn("w4", F.pow(F.col("w") / F.col("top"), 4.0) / (10 + F.abs("perp")))
    major, minor, angle = geometry.principal_axes()
    m = geometry.weighted_moments(j.select(*keys, F.col("par").alias("x"), F.col("perp").alias("y"), "w4"), keys, "w4")
    return m.withColumns({"major": major, "minor": minor, "angle": angle})


def ridge(pix: DataFrame, keys: list[str], least: int = 12) -> DataFrame:
    """Q-21: at each whole position along the edge with more than least pixels, the w^4-weighted centre across it over five positions."""
    at = F.rint("par").cast("int")
    top = pix.groupBy(*keys).agg(F.max("w").alias("top"))
    j = pix.join(top, keys).withColumn("q", F.pow(F.col("w") / F.col("top"), 4.0))
    s = j.groupBy(*keys, at.alias("seq")).agg(F.count("*").alias("n"), F.sum(F.col("q") * F.col("perp")).alias("a"), F.sum("q").alias("b")).where(F.col("n") > least)
    w = W.partitionBy(*keys).orderBy("seq").rowsBetween(-2, 2)
    return s.select(*keys, "seq", (F.sum("a").over(w) / F.sum("b").over(w)).alias("perp"))


def robust_line(pts: DataFrame, keys: list[str], tol: float = 3.0) -> DataFrame:
    """H7: of the lines through two points, the one with most points within tol, then the least rms, fitted to its inliers.

    Points are one for each sampled column of a picture, so a key's pairs are bounded. Most inliers win, then the least error: a stated deviation.
    """
    a = pts.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = pts.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"))
    slope = (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0))
    c = a.join(b, keys).where("x1 < x2").select(*keys, "x1", "x2", slope.alias("m"), (F.col("y1") - slope * F.col("x1")).alias("c"))
    e = c.join(pts, keys).withColumn("e", F.col("y") - F.col("m") * F.col("x") - F.col("c")).where(F.abs("e") <= tol)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = e.groupBy(*keys, "x1", "x2").agg(F.count("*").alias("n"), F.avg(F.col("e") ** 2).alias("ms"), F.avg(x).alias("ax"), F.avg(y).alias("ay"), F.avg(x * x).alias("axx"), F.avg(x * y).alias("axy"))
    best = s.groupBy(*keys).agg(F.max(F.struct("n", (-F.round("ms", 9)).alias("nms"), (-F.col("x1")).alias("a"), (-F.col("x2")).alias("b"), "ax", "ay", "axx", "axy")).alias("s"))
    m = (F.col("s.axy") - F.col("s.ax") * F.col("s.ay")) / (F.col("s.axx") - F.col("s.ax") * F.col("s.ax"))
    return best.select(*keys, F.col("s.n").alias("inliers"), m.alias("slope"), (F.col("s.ay") - m * F.col("s.ax")).alias("offset"))


def fill_bars(px: DataFrame, bounds: DataFrame) -> DataFrame:
    """H8: rows outside an image's bounds (y0, y1) get its fill value."""
    j = px.join(bounds, "image_id")
    return j.select("image_id", "y", "x", F.when(F.col("y").between(F.col("y0"), F.col("y1")), F.col("v")).otherwise(F.col("fill")).alias("v"))


def largest_hole(comps: DataFrame, px: DataFrame, images: DataFrame) -> DataFrame:
    """For each object, the boundary length of its largest hole: 4-connected background without a pixel on the frame."""
    back = px.select("image_id", "y", "x").join(comps, ["image_id", "y", "x"], "left_anti")
    bg = geometry.component_pixels(geometry.connected_components(geometry.runs(back), reach=0))
    on_frame = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    outer = bg.join(images, "image_id").where(on_frame).select("image_id", "label").distinct()
    holes = bg.join(outer, ["image_id", "label"], "left_anti")
    length = geometry.boundaries(holes).groupBy("image_id", F.col("label").alias("hole")).agg(F.count("*").alias("length"))
    first = holes.groupBy("image_id", F.col("label").alias("hole")).agg(F.min(F.struct("y", "x")).alias("p")).select("image_id", "hole", F.col("p.y").alias("y"), (F.col("p.x") - 1).alias("x"))
    owner = first.join(comps, ["image_id", "y", "x"]).select("image_id", "hole", "label")
    return owner.join(length, ["image_id", "hole"]).groupBy("image_id", "label").agg(F.max("length").alias("hole_len"))


def gaussian_centroid(lsf: DataFrame, keys: list[str], rounds: int = 11) -> DataFrame:
    """The centroid of a line spread under a Gaussian window that is moved and resized to it, rounds times, from a Hann-weighted start; in pixels."""
    packed = lsf.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda e: F.abs(e["v"])).alias("a"))
    n = F.size("a")
    total = lambda f: F.aggregate(F.transform("a", f), F.lit(0.0), lambda s, x: s + x)
    hann = lambda v, i: v * (0.5 - 0.5 * F.cos(2 * math.pi * i / n))
    packed = packed.withColumn("c", total(lambda v, i: hann(v, i) * i) / total(hann)).withColumn("s2", F.lit(256.0))
    for _ in range(rounds):
        g = lambda v, i: v * F.exp(-((i - F.col("c")) ** 2) / (2 * F.col("s2")))
        packed = packed.withColumn("t", total(g)).withColumn("c2", total(lambda v, i: g(v, i) * i) / F.col("t"))
        packed = packed.withColumn("s2n", F.greatest(F.lit(1.0), F.least(F.lit(256.0), total(lambda v, i: g(v, i) * (i - F.col("c2")) ** 2) / F.col("t"))))
        packed = packed.select(*keys, "a", F.col("c2").alias("c"), F.col("s2n").alias("s2"))
    return packed.select(*keys, ((F.col("c") - 256) / 8).alias("centroid"))


def esf_loess(samples: DataFrame, keys: list[str], reach: float = 2.25, degree: int = 6, ridge_weight: float = 5e-5, core: int = 128) -> DataFrame:
    """A Chebyshev fit of this degree to the samples within reach of each bin of the core, by ridge regression.

    Spark sums the moments of each bin; the solves, seven unknowns a bin, run grouped by edge on at most 2 core rows. Each bin's values are
    taken about its own mean, a stated deviation.
    """
    c = (F.col("perp") * 8 + 256).cast("int")
    r = int(reach * 8)
    near = samples.select(*keys, "perp", "v", F.explode(F.sequence(c - r, c + r)).alias("bin")).where(F.abs(F.col("bin") - 256) <= core)
    u = (F.col("perp") - (F.col("bin") - 256) / 8.0) / reach
    near = near.withColumn("u", u).where(F.abs("u") <= 1)
    cheb = [F.lit(1.0), F.col("u")]
    for _ in range(2, 2 * degree + 1):
        cheb.append(2 * F.col("u") * cheb[-1] - cheb[-2])
    # T_i T_j = (T_(i+j) + T_|i-j|) / 2, so 2 degree + 1 sums make the matrix
    sums = near.groupBy(*keys, "bin").agg(*[F.sum(cheb[i]).alias(f"m{i}") for i in range(2 * degree + 1)], *[F.sum(cheb[i] * F.col("v")).alias(f"b{i}") for i in range(degree + 1)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema.fields)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        m = g[[f"m{i}" for i in range(2 * degree + 1)]].to_numpy()
        b = g[[f"b{i}" for i in range(degree + 1)]].to_numpy()
        i = np.arange(degree + 1)
        a = (m[:, i[:, None] + i[None, :]] + m[:, np.abs(i[:, None] - i[None, :])]) / 2
        mean = b[:, :1] / m[:, :1]
        b = b - mean * m[:, : degree + 1]
        x = np.linalg.solve(a + ridge_weight * m[:, :1, None] * np.eye(degree + 1), b[:, :, None])[:, :, 0]
        at0 = np.array([[1, 0, -1, 0][k % 4] for k in i])
        return g[keys].assign(bin=g["bin"], v=x @ at0 + mean[:, 0])

    return sums.groupBy(*keys).applyInPandas(solve, f"{fields}, bin int, v double")


#: The ridge penalty of the edge's feet by the contrast-to-noise ratio.
FEET_PENALTY = [
    (4, 95), (5, 92), (6, 89), (7, 86), (8, 83), (9, 79), (10, 76), (12, 70), (14, 63), (16, 58), (18, 53), (20, 49), (22, 46), (24, 43), (26, 42), (28, 40), (30, 39), (35, 38), (40, 38),
    (45, 36), (50, 34), (60, 30), (70, 27), (80, 22), (90, 14), (100, 7), (124, 2), (149, 2), (794, 1), (894, 1), (1000, 5e-8)]


def esf_loess_zones(samples: DataFrame, about: DataFrame, keys: list[str], alpha: float = 13.0, reach: float = 2.25, degree: int = 6) -> DataFrame:
    """B12 in full: keys, bin, v: the edge spread at every bin between the outermost samples.

    about: keys, half_width (of the transition, in eighths of a pixel, from B6) and cnr. In the core, half_width and three bins to both sides, a Chebyshev fit to
    the samples within reach, weighted by an exponential kernel that is flat over an eighth of a pixel (a quarter in the outer half). Its values are taken
    relative to the bin before, and beyond three quarters of the core a ridge penalty that follows from the noise pulls them to it. Outside, a box mean of 0.24
    pixels each way at the core, of 1 at twice its width and 1.5 from 2.25 times on. An empty box repeats the bin before, as does a bin with seven samples or fewer within reach.

    Spark sums the moments of each bin. A bin's value is then linear in the one before, so one pass over an edge's bins, at most 512, runs grouped.
    """
    size, wide = degree + 1, 2 * degree + 1
    low, high = F.floor(F.col("first") * 8 + 257).cast("int"), F.floor(F.col("last") * 8 + 255).cast("int")
    ends = samples.groupBy(*keys).agg(F.min("perp").alias("first"), F.max("perp").alias("last")).select(*keys, low.alias("low"), high.alias("high"))
    frame = about.select(*keys, "half_width", "cnr").join(ends, keys)
    c, r = F.floor(F.col("perp") * 8 + 256).cast("int"), int(reach * 8)
    own = samples.select(*keys, "perp", "v").join(frame, keys)  # before a sample has a row for each bin: only samples are shuffled
    near = own.withColumn("bin", F.explode(F.sequence(c - r, c + r + 1))).where((F.col("bin") >= F.col("low")) & (F.col("bin") < F.col("high")))
    mid = (F.col("bin") - 256) / 8.0
    near = near.withColumns({"mid": mid, "core": F.abs(mid) < F.col("half_width") / 8 + 0.375, "d": F.col("perp") - mid}).where((F.col("d") >= -reach) & (F.col("d") < reach))
    foot, middle, top = F.col("half_width") / 8 + 0.375, F.col("half_width") / 4.0, 2.25 * F.col("half_width") / 8
    out = F.abs("mid")
    span = F.when(out >= top, 1.5).when(out >= middle, 1 + (out - middle) / F.nullif(top - middle, F.lit(0.0)) * 0.5).otherwise(0.24 + (out - foot) / F.nullif(middle - foot, F.lit(0.0)) * 0.76)
    flat = F.when(out >= F.col("half_width") / 16, 0.25).otherwise(0.125)
    kernel = F.when(F.abs("d") < flat, 1.0).otherwise(F.exp(-alpha * (F.abs("d") - flat)))
    near = near.withColumns({"w": F.when(F.col("core"), kernel * kernel), "inside": ~F.col("core") & (F.col("d") >= -span) & (F.col("d") < span), "u": F.col("d") / reach})
    cheb = [F.lit(1.0), F.col("u")]
    for _ in range(2, wide):
        cheb.append(2 * F.col("u") * cheb[-1] - cheb[-2])
    near = near.withColumn("t", F.array(*cheb))
    moments = [F.sum(F.col("w") * F.col("t")[i]).alias(f"m{i}") for i in range(wide)]
    values = [F.sum(F.col("w") * F.col("t")[i] * F.col("v")).alias(f"b{i}") for i in range(size)]
    sums = near.groupBy(*keys, "bin", "half_width", "cnr", "low", "high", "core").agg(F.count("*").alias("n"), F.count_if("inside").alias("boxed"), F.sum(F.when(F.col("inside"), F.col("v"))).alias("box"), *moments, *values)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema.fields)
    noise, penalty = (np.array(x, float) for x in zip(*FEET_PENALTY, strict=True))

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        width, bins = float(g["half_width"].iloc[0]), np.arange(int(g["low"].iloc[0]), int(g["high"].iloc[0]))
        own, pull = np.full(len(bins), np.nan), np.zeros(len(bins))  # v = own + pull * (v of the bin before)
        e = g[g["core"] & (g["n"] >= size)]
        if len(e):
            i = np.arange(size)
            m, b = e[[f"m{k}" for k in range(wide)]].to_numpy(), e[[f"b{k}" for k in i]].to_numpy()
            a = (m[:, i[:, None] + i[None, :]] + m[:, np.abs(i[:, None] - i[None, :])]) / 2
            far = np.abs(e["bin"].to_numpy() - 256) / 8 > 0.75 * width / 8
            a = a + np.where(far, np.interp(e["cnr"].iloc[0], noise, penalty), 5e-8)[:, None, None] * np.eye(size)
            x = np.linalg.solve(a, np.stack((b, m[:, :size]), axis=2))
            at0 = np.array([[1, 0, -1, 0][k % 4] for k in i])
            value, share = at0 @ x[:, :, 0].T, at0 @ x[:, :, 1].T
            own[e["bin"] - bins[0]], pull[e["bin"] - bins[0]] = value, 1 - share
        o = g[~g["core"] & (g["n"] >= size) & (g["boxed"] > 0)]
        own[o["bin"] - bins[0]] = o["box"] / o["boxed"]
        v, before = np.empty(len(bins)), 0.0
        for k in range(len(bins)):
            before = v[k] = before if np.isnan(own[k]) else own[k] + pull[k] * before
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "bin": bins, "v": v})

    return sums.groupBy(*keys).applyInPandas(scan, f"{fields}, bin int, v double")


def rational_fit(ps: DataFrame, keys: list[str], x: str, y: str, n: int = 4, m: int = 2, passes: int = 8, at: int = 64) -> DataFrame:
    """A rational curve of orders (n, m) in Chebyshev terms, by re-linearised normal equations, and its peak.

    The first pass sums the moments in Spark; the small solve runs grouped, one row for each key. Later passes weight by the last denominator;
    samples off by more than 5 % weigh nothing from the second pass on.
    """
    span = ps.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.max(F.abs(y)).alias("top")).where("x1 > x0 and top > 0")
    s = ps.join(span, keys).withColumn("u", 2 * (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")) - 1).withColumn("t", F.col(y) / F.col("top"))
    size = n + 1 + m
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ps.select(*keys).schema.fields)

    def terms(u):
        out = [F.lit(1.0), u]
        for _ in range(2, max(n, m) + 1):
            out.append(2 * u * out[-1] - out[-2])
        return out

    t = terms(F.col("u"))
    basis = [*t[: n + 1], *[-F.col("t") * t[k] for k in range(1, m + 1)]]
    coef = span.select(*keys, F.array(*[F.lit(0.0)] * size).alias("c"))
    dense = np.linspace(-1, 1, at * 16)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        row = g.iloc[0]
        a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        b = np.array([row[f"b{i}"] for i in range(size)])
        c = np.linalg.lstsq(a + 1e-9 * np.trace(a) / size * np.eye(size), b, rcond=None)[0]
        return pd.DataFrame({**{k: [row[k]] for k in keys}, "c": [c]})

    for p in range(passes):
        j = s.join(coef, keys)
        q = sum((F.col("c")[n + k] * t[k] for k in range(1, m + 1)), F.lit(1.0))
        value = sum((F.col("c")[k] * t[k] for k in range(n + 1)), F.lit(0.0)) / q
        w = F.lit(1.0) if p == 0 else F.when((F.abs(q) < 0.05) | ((F.abs(value - F.col("t")) > 0.05 * F.abs("t")) & F.lit(p > 1)), 0.0).otherwise(1 / (q * q))
        j = j.withColumn("w", w)
        sums = j.groupBy(*keys).agg(*[F.sum(F.col("w") * basis[a] * basis[b]).alias(f"a{a}_{b}") for a in range(size) for b in range(a, size)], *[F.sum(F.col("w") * basis[a] * F.col("t")).alias(f"b{a}") for a in range(size)])
        coef = sums.groupBy(*keys).applyInPandas(solve, f"{fields}, c array<double>")

    def peak(g: pd.DataFrame) -> pd.DataFrame:
        row = g.iloc[0]
        c = np.asarray(row["c"])
        v = np.polynomial.chebyshev.chebval(dense, c[: n + 1]) / np.polynomial.chebyshev.chebval(dense, np.concatenate(([1.0], c[n + 1 :])))
        i = int(np.nanargmax(np.where(np.isfinite(v), v, -np.inf)))
        u = dense[i]
        if 0 < i < len(dense) - 1:
            bend = v[i - 1] - 2 * v[i] + v[i + 1]
            u += (dense[1] - dense[0]) * 0.5 * (v[i - 1] - v[i + 1]) / bend if bend < 0 else 0
        return pd.DataFrame({**{k: [row[k]] for k in keys}, "peak": [row["x0"] + (u + 1) / 2 * (row["x1"] - row["x0"])], "value": [v[i] * row["top"]]})

    return coef.join(span, keys).groupBy(*keys).applyInPandas(peak, f"{fields}, peak double, value double")


def _cubic(t):
    """The four cubic B-spline weights of knots -1, 0, 1 and 2 at t in 0 .. 1, columns or numbers."""
    return [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]


def _banded_solve(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The solution of a x = z for a symmetric positive definite band matrix: a[i, d] is the entry at row i, column i + d."""
    n, width = a.shape
    low, x = a.astype(float).copy(), z.astype(float).copy()
    for i in range(n):  # Cholesky, column by column: only the band fills
        low[i] /= np.sqrt(low[i, 0])
        for d in range(1, min(width, n - i)):
            low[i + d, : width - d] -= low[i, d] * low[i, d:]
    for i in range(n):
        x[i] /= low[i, 0]
        end = min(width, n - i)
        x[i + 1 : i + end] -= low[i, 1:end] * x[i]
    for i in range(n - 1, -1, -1):
        end = min(width, n - i)
        x[i] = (x[i] - low[i, 1:end] @ x[i + 1 : i + end]) / low[i, 0]
    return x


def surface_fit(cells: DataFrame, keys: list[str], cell_span: int = 4, smooth: float = 0.1, rows: int = 1, columns: int = 1, prune: int | None = None) -> DataFrame:
    """A smoothing surface over grid cells (gy, gx, v): tensor cubic B-splines with knots every cell_span cells, first differences penalised,
    evaluated at every cell of the grid: keys, gy, gx, v, far (knots to the nearest that has cells, city blocks).

    The grid has rows x columns cells, or more where cells lie beyond; its extent gives the number of knot intervals in each
    direction. An interval without cells takes the largest of the values of the nearest ones with cells, as a point in its middle of weight
    1e-4; where under 60 % of the intervals have cells, the surface is ten times as smooth; differences beyond the grid count half.
    With prune, places more than prune intervals from any cell are left out. Spark joins each cell to its sixteen coefficients and sums the normal equations; their band matrix, as
    wide as four rows of coefficients, is solved by Cholesky, grouped by key.
    """
    extent = cells.groupBy(*keys).agg(F.greatest(F.lit(rows), F.max("gy") + 1).alias("ny"), F.greatest(F.lit(columns), F.max("gx") + 1).alias("nx"))
    iy, ix = F.floor(F.col("gy") / cell_span).cast("int"), F.floor(F.col("gx") / cell_span).cast("int")
    c = cells.join(extent, keys).withColumns({"iy": iy, "ix": ix})
    c = c.withColumns({"ty": F.array(*_cubic(F.col("gy") / float(cell_span) - F.col("iy"))), "tx": F.array(*_cubic(F.col("gx") / float(cell_span) - F.col("ix")))})
    four = F.sequence(F.lit(0), F.lit(3))
    touched = F.flatten(F.transform(four, lambda p: F.transform(four, lambda q: F.struct((F.col("iy") + p).alias("y"), (F.col("ix") + q).alias("x"), (F.get("ty", p) * F.get("tx", q)).alias("w")))))
    c = c.withColumn("c", touched).drop("ty", "tx")
    pairs = c.select(*keys, "ny", "nx", "v", F.explode("c").alias("a"), "c").select(*keys, "ny", "nx", "v", "a", F.explode("c").alias("b"))
    after = (F.col("b.y") > F.col("a.y")) | ((F.col("b.y") == F.col("a.y")) & (F.col("b.x") >= F.col("a.x")))
    entry = [F.col("a.y").alias("y"), F.col("a.x").alias("x"), (F.col("b.y") - F.col("a.y")).alias("dy"), (F.col("b.x") - F.col("a.x")).alias("dx")]
    own = F.when((F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x")), F.col("a.w") * F.col("v"))
    normal = pairs.where(after).groupBy(*keys, "ny", "nx", *entry).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("m"), F.sum(own).alias("z"))
    full = c.groupBy(*keys, "ny", "nx", F.col("iy").alias("y"), F.col("ix").alias("x")).agg(F.avg("v").alias("mean"))
    null = lambda kind: F.lit(None).cast(kind)
    both = normal.withColumn("mean", null("double")).unionByName(full.withColumns({"dy": null("int"), "dx": null("int"), "m": null("double"), "z": null("double")}))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema.fields)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(g["ny"].iloc[0]), int(g["nx"].iloc[0])
        sy, sx = (ny - 1) // cell_span + 1, (nx - 1) // cell_span + 1  # intervals between knots; three coefficients more in each direction
        ky, kx = sy + 3, sx + 3
        a, z = np.zeros((ky * kx, 3 * kx + 4)), np.zeros(ky * kx)
        e = g[g["m"].notna()]
        at = (e["y"] * kx + e["x"]).to_numpy(np.int64)
        np.add.at(a, (at, (e["dy"] * kx + e["dx"]).to_numpy(np.int64)), e["m"].to_numpy())
        diagonal = e["z"].notna().to_numpy()
        z[at[diagonal]] = e["z"].to_numpy()[diagonal]
        f = g[g["mean"].notna()]
        value, far = np.full((sy, sx), -np.inf), np.full((sy, sx), -1)
        value[f["y"], f["x"]], far[f["y"], f["x"]] = f["mean"], 0
        step = 0
        while (far < 0).any():  # each step fills the intervals beside those that are filled
            step += 1
            wide = np.pad(value, 1, constant_values=-np.inf)
            near = np.max([wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]], axis=0)
            new = (far < 0) & (near > -np.inf)
            value[new], far[new] = near[new], step
        middle = np.array(_cubic(0.5))
        weights = np.outer(middle, middle).ravel()
        offsets = np.add.outer(np.arange(4) * kx, np.arange(4)).ravel()
        for y, x in zip(*np.nonzero(far > 0), strict=True):
            p = y * kx + x + offsets
            z[p] += 1e-4 * weights * value[y, x]
            for i in range(16):
                a[p[i], offsets[i:] - offsets[i]] += 1e-4 * weights[i] * weights[i:]
        weight = smooth * (10 if (far == 0).sum() < 0.6 * sy * sx else 1)
        index = np.arange(ky * kx).reshape(ky, kx)
        for first, second, place in ((index[:, :-1], index[:, 1:], np.arange(kx - 1)[None, :] >= 2), (index[:-1], index[1:], np.arange(ky - 1)[:, None] >= 2)):
            w = np.broadcast_to(np.where(place, weight, weight / 4), first.shape).ravel()  # differences of the first coefficients, beyond the grid, count half
            i, j = first.ravel(), second.ravel()
            np.add.at(a, (i, 0), w)
            np.add.at(a, (j, 0), w)
            np.add.at(a, (i, j - i), -w)
        a[:, 0] += 1e-9
        x = _banded_solve(a, z).reshape(ky, kx)
        y, h = np.arange(ny), np.arange(nx)
        by, bx = np.zeros((ny, ky)), np.zeros((nx, kx))
        for p, (u, v) in enumerate(zip(_cubic(y % cell_span / cell_span), _cubic(h % cell_span / cell_span), strict=True)):
            by[y, y // cell_span + p], bx[h, h // cell_span + p] = u, v
        gy, gx = np.meshgrid(y, h, indexing="ij")
        away = far[gy // cell_span, gx // cell_span].ravel()
        out = pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "gy": gy.ravel(), "gx": gx.ravel(), "v": (by @ x @ bx.T).ravel(), "far": away})
        return out if prune is None else out[away <= prune]

    return both.groupBy(*keys).applyInPandas(solve, f"{fields}, gy int, gx int, v double, far int")


def surface_eval(surface: DataFrame, keys: list[str], step: int, prune: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """A fitted surface (R6) on a coarser grid, every step cells, without places more than prune knots from any cell, values clamped to lo .. hi."""
    v = F.col("v") if lo is None else F.greatest(F.lit(lo), F.col("v"))
    v = v if hi is None else F.least(F.lit(hi), v)
    return surface.where((F.col("gy") % step == 0) & (F.col("gx") % step == 0) & (F.col("far") <= prune)).select(*keys, "gy", "gx", v.alias("v"))
