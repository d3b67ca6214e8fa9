"""Lens distortion: radial models, tables, and the fit of the division model to ridges. Points have x, y relative to the centre."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.session import broadcast_if_small, materialise, ship_package


def _scaled(pts: DataFrame, to: Column) -> DataFrame:
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    k = F.when(r > 0, to / r).otherwise(1.0)
    return pts.withColumn("x2", F.col("x") * k).withColumn("y", F.col("y") * k).withColumn("x", F.col("x2")).drop("x2")


def _radius() -> Column:
    return F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)


def equiangular(pts: DataFrame, f: float, inverse: bool = False) -> DataFrame:
    """L1: r' = f atan(r / f), and back."""
    return _scaled(pts, f * F.tan(_radius() / f) if inverse else f * F.atan(_radius() / f))


def stereographic(pts: DataFrame, f: float, inverse: bool = False) -> DataFrame:
    """L2: r' = 2 f tan(atan(r / f) / 2), and back."""
    return _scaled(pts, f * F.tan(2 * F.atan(_radius() / (2 * f))) if inverse else 2 * f * F.tan(F.atan(_radius() / f) / 2))


def division_inverse(pts: DataFrame, k1, k2) -> DataFrame:
    """L3: r / (1 + k1 r^2 + k2 r^4); the corner's radius is 1."""
    r2 = F.col("x") ** 2 + F.col("y") ** 2
    d = 1 + k1 * r2 + k2 * r2 * r2
    return pts.withColumns({"x": F.col("x") / d, "y": F.col("y") / d})


def division_forward(pts: DataFrame, k1: float | Column, k2: float | Column = 0.0, steps: int = 12) -> DataFrame:
    """L4: the smallest positive root of ru (1 + k1 r^2 + k2 r^4) - r = 0: closed for k2 = 0, from there by Newton's steps. Coefficients may be columns."""
    ru = _radius()
    disc = F.greatest(1 - 4 * k1 * ru * ru, F.lit(0.0))
    start = 2 * ru / (1 + F.sqrt(disc))
    if not isinstance(k2, Column) and not k2:
        return _scaled(pts, start)

    def step(r, _):
        rise = ru * (2 * k1 * r + 4 * k2 * r * r * r) - 1
        return r - (ru * (1 + k1 * r * r + k2 * r * r * r * r) - r) / F.when(F.abs(rise) < 1e-9, F.lit(-1e-9)).otherwise(rise)

    return _scaled(pts, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))


def radial_table(images: DataFrame, model, spacing: float, most: float) -> DataFrame:
    """R and model(r) at equal spacing up to most, for each image: a table of fixed size."""
    t = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(int(math.ceil(most / spacing)) + 1))))
    r = F.col("i") * spacing
    return t.withColumn("r", r).withColumn("rd", model(r))


def table_lookup(pts: DataFrame, table: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """The radius of each point through the table, a parabola through three neighbours; an equi join on the index."""
    i = F.greatest(F.lit(1), F.rint(F.col("radius") / spacing).cast("int"))
    near = pts.withColumn("i0", i).withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("i", F.col("i0") + F.col("d"))
    t = F.col("radius") / spacing - F.col("i0")
    w = F.when(F.col("d") == -1, t * (t - 1) / 2).when(F.col("d") == 0, 1 - t * t).otherwise(t * (t + 1) / 2)
    j = near.withColumn("w", w).join(table.select(*keys, "i", "rd"), [*keys, "i"])
    return j.groupBy(*keys, "point_id").agg(F.sum(F.col("w") * F.col("rd")).alias("rd"))


def remap(px: DataFrame, target: DataFrame) -> DataFrame:
    """The picture through a warp: target pixels (y, x) with source places (sy, sx); bilinear, zero outside."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    ty, tx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    t = target.withColumn("c", F.explode(corners))
    w = F.when(F.col("c.a") == 1, ty).otherwise(1 - ty) * F.when(F.col("c.b") == 1, tx).otherwise(1 - tx)
    t = t.select("image_id", F.col("y").alias("qy"), F.col("x").alias("qx"), w.alias("w"), (F.floor("sy") + F.col("c.a")).cast("int").alias("y"), (F.floor("sx") + F.col("c.b")).cast("int").alias("x"))
    j = t.join(px, ["image_id", "y", "x"], "left")
    return j.groupBy("image_id", F.col("qy").alias("y"), F.col("qx").alias("x")).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("v"))


def warp_padding(images: DataFrame, f: float, edge: float = 80.0, least: float = 20.0, cap: int = 8000) -> DataFrame:
    """How far a picture may extend so that an edge of 80 pixels still maps to 20 by the equiangular model: the first failing radius, even, capped."""
    steps = images.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(cap))))
    shrunk = f * (F.atan((F.col("r") + edge) / f) - F.atan(F.col("r") / f))
    bad = steps.withColumn("bad", shrunk < least)
    return bad.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("r"))), F.lit(cap)).alias("r")).select("image_id", (F.col("r") - F.col("r") % 2).alias("padding"))


def select_ridges(ridge: DataFrame, angles: DataFrame, keys: list[str], cos_min: float = 0.17365, step: int = 3) -> DataFrame:
    """Ridges of more than two points whose normal isn't tangential, every step-th point."""
    n = F.count("*").over(W.partitionBy(*keys))
    i = F.row_number().over(W.partitionBy(*keys).orderBy("seq")) - 1
    r = ridge.withColumn("n", n).withColumn("i", i).where((F.col("n") > 2) & (F.col("i") % step == 0))
    return r.join(angles.where(F.abs("cos_radial") > cos_min).select(*keys), keys, "left_semi").select(*ridge.columns)


def invertible(k1: Column, k2: Column, r: float) -> Column:
    """Whether r / (1 + k1 r^2 + k2 r^4) rises up to r: the derivative 1 - k1 r^2 - 3 k2 r^4 is positive there and at its least."""
    at = lambda s: 1 - k1 * s - 3 * k2 * s * s
    vertex = -k1 / (6 * k2)
    inside = (k2 < 0) & (vertex > 0) & (vertex < r * r)
    return (at(F.lit(r * r)) > 0) & (F.when(inside, at(vertex)).otherwise(1.0) > 0)


def ridge_costs(ridge: DataFrame, candidates: DataFrame, keys: list[str], lens: list[str] | None = None, order: str = "seq") -> DataFrame:
    """L9 by ridge: 1 / Durbin-Watson of the corrected points about their line, for each candidate (cand, k1, k2): cand, lens, keys, t.

    A point keeps the one before it, so a candidate corrects both and needs sums alone: of positions along and across the ridge's
    chord for the line, and of their steps for the differences of residuals. Large t: residuals that follow one another, a bent
    ridge; about 1/2: noise. Ridges without three points or without steps in their residuals have a null t.
    Candidates are a fixed grid, for all ridges or, with lens, for those of each lens: a constant factor.
    """
    lens = lens or []
    by = ["cand", *lens, *[k for k in keys if k not in lens]]
    w = W.partitionBy(*by[1:]).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = {f"{c}{n}": f(c).over(whole) for c in ("x", "y") for n, f in ((0, F.first), (1, F.last))}
    pts = ridge.withColumns({"xb": F.lag("x").over(w), "yb": F.lag("y").over(w), **ends})
    long = F.nullif(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(0.0))
    pts = pts.withColumns({"c": (F.col("x1") - F.col("x0")) / long, "s": (F.col("y1") - F.col("y0")) / long})
    pts = pts.join(candidates, lens) if lens else pts.join(broadcast_if_small(candidates))

    def along_across(x: str, y: str) -> tuple[Column, Column]:
        r2 = F.col(x) ** 2 + F.col(y) ** 2
        d = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
        dx, dy = F.col(x) / d - F.col("x0"), F.col(y) / d - F.col("y0")
        return dx * F.col("c") + dy * F.col("s"), dy * F.col("c") - dx * F.col("s")

    u, v = along_across("x", "y")
    ub, vb = along_across("xb", "yb")
    pts = pts.select(*by, u.alias("u"), v.alias("v"), (u - ub).alias("du"), (v - vb).alias("dv"))
    total = lambda a, b, n: F.sum(F.col(a) * F.col(b)).alias(n)
    m = pts.groupBy(*by).agg(F.count("v").cast("double").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), total("u", "u", "suu"), total("u", "v", "suv"), total("v", "v", "svv"), total("du", "du", "duu"), total("du", "dv", "duv"), total("dv", "dv", "dvv"))
    n = F.col("n")
    cuu, cuv, cvv = F.col("suu") - F.col("su") ** 2 / n, F.col("suv") - F.col("su") * F.col("sv") / n, F.col("svv") - F.col("sv") ** 2 / n
    m = m.withColumns({"b": cuv / F.nullif(cuu, F.lit(0.0)), "cuv": cuv, "cvv": cvv})
    squares = F.greatest(F.col("cvv") - F.col("b") * F.col("cuv"), F.lit(0.0))
    steps = F.col("dvv") - 2 * F.col("b") * F.col("duv") + F.col("b") ** 2 * F.col("duu")
    return m.select(*by, F.when((n >= 3) & (steps > 0), squares / steps).alias("t"))


def straightness(ridge: DataFrame, candidates: DataFrame, keys: list[str], lens: list[str] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """For each candidate (and lens) the weighted mean over ridges of 1 / Durbin-Watson: cand, lens, cost. weights: keys, weight; 1 without it."""
    cost = ridge_costs(ridge, candidates, keys, lens).where("t is not null")
    cost = cost.join(weights, keys) if weights is not None else cost.withColumn("weight", F.lit(1.0))
    return cost.groupBy("cand", *(lens or [])).agg((F.sum(F.col("weight") * F.col("t")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("cost"))


def _grid_fit(ridge: DataFrame, keys: list[str], lens: list[str], rounds: int, span, n: int, zoom: float) -> DataFrame:
    offset = F.lit((span[1] - span[0]) / 2)
    place = lambda i: 2.0 * i / (n - 1) - 1
    best = ridge.select(*lens).distinct().withColumns({"k1": F.lit(sum(span) / 2), "k2": F.lit(sum(span) / 2)})
    for r in range(rounds):
        grid = best.select(*lens, "k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("cand"))
        reach = offset * zoom**r
        # round 0 starts from the span's middle; no distortion at all is a candidate too
        k1 = F.when((F.col("cand") == n * n // 2) & F.lit(r == 0), 0.0).otherwise(F.col("k1") + reach * place(F.floor(F.col("cand") / n)))
        k2 = F.when((F.col("cand") == n * n // 2) & F.lit(r == 0), 0.0).otherwise(F.col("k2") + reach * place(F.col("cand") % n))
        grid = grid.select(*lens, "cand", k1.alias("k1"), k2.alias("k2")).where((F.abs("k2") < 1e-12) & (F.col("k1") < 0.8) | invertible(F.col("k1"), F.col("k2"), 1.1))
        cost = straightness(ridge, grid, keys, lens).join(grid, ["cand", *lens])
        best = materialise(cost.groupBy(*lens).agg(F.min_by(F.struct("k1", "k2", "cost"), F.struct("cost", "cand")).alias("b")).select(*lens, "b.*"), "distortion")
    return best


def fit_distortion(ridge: DataFrame, keys: list[str], lens: list[str], rounds: int = 9, span=(-2.0, 1.5), n: int = 9, zoom: float = 0.4, most_dropped: float = 0.3) -> DataFrame:
    """(lens, k1, k2, cost, ridges, dropped) for each lens, by grids of n x n candidates; each round is zoomed on the lens's best of the last.

    All lenses are fitted at once, in one job a round; a candidate that doesn't rise up to the corner is left out. Ridges whose
    residuals are outliers at the best candidate (L12) are dropped where they are fewer than most_dropped of a lens's
    ridges, and that lens is fitted anew over the whole span. keys name a ridge; the lens's columns may be among them.
    """
    ridge = materialise(ridge, "ridges")
    first = _grid_fit(ridge, keys, lens, rounds, span, n, zoom)
    at = ridge_costs(ridge, first.select(*lens, F.lit(0).alias("cand"), "k1", "k2"), keys, lens)
    own = [*lens, *[k for k in keys if k not in lens]]
    judged = materialise(medcouple_outliers(at.select(*own, F.coalesce(F.log1p("t"), F.lit(1e6)).alias("e")), lens), "ridge-residuals")
    counts = judged.groupBy(*lens).agg(F.count("*").alias("ridges"), F.count_if("outlier").alias("outliers"))
    again = (F.col("outliers") > 0) & (F.col("ridges") - F.col("outliers") > (1 - most_dropped) * F.col("ridges"))
    counts = materialise(counts.withColumn("dropped", F.when(again, F.col("outliers")).otherwise(0)).select(*lens, "ridges", "dropped"), "dropped-ridges")
    found = first.join(counts.where("dropped = 0"), lens)
    if counts.where("dropped > 0").isEmpty():
        return found
    kept = judged.where("not outlier").join(counts.where("dropped > 0"), lens, "left_semi").select(*own)
    second = _grid_fit(materialise(ridge.join(kept, own, "left_semi"), "ridges"), keys, lens, rounds, span, n, zoom)
    return found.unionByName(second.join(counts, lens))


def medcouple(x: np.ndarray) -> float:
    """The medcouple of sorted values: the upper median of h(a, b) = (a + b) / (a - b) over values a above and b below the median, all less it.

    h falls with -b and rises with a, so values below a bound are counted by one search for each a; the bound is halved in until few
    pairs are left, which are computed: n log n steps, no matrix. Pairs of values that equal the median count by the sign of the
    difference of their places.
    """
    mid = x[len(x) // 2]
    up = x[1:][x[1:] >= mid][::-1] - mid
    down = mid - x[x <= mid]
    p, q = len(up), len(down)
    level_up, level_down = int((up == 0).sum()), int((down == 0).sum())
    turn = (level_up - 1 - np.arange(level_up)) - (q - level_down)  # sign(turn - t) for t = 0 .. level_down - 1
    above = int(np.clip(turn, 0, level_down).sum())
    same = int(((turn >= 0) & (turn < level_down)).sum())
    ties = [(-1.0, level_up * level_down - above - same), (0.0, same), (1.0, above)]
    rank = p * q // 2
    rows, times = np.unique(up[up > 0], return_counts=True)  # where up is 0, h is -1 for all b but the ties
    down, down_times = np.unique(down, return_counts=True)
    sums = np.concatenate(([0], np.cumsum(down_times)))
    minus = level_up * (q - level_down)

    def ends(t: float) -> np.ndarray:
        """How many values b of each row have h >= t, as h falls along down."""
        return np.searchsorted(down, rows * (1 - t) / (1 + t), "right") if t > -1 else np.full(len(rows), len(down))

    def below(t: float) -> int:
        return int((times * (q - sums[ends(t)])).sum()) + (minus if t > -1 else 0) + sum(c for v, c in ties if v < t)

    lo, hi = -1.0, 1.0 + 1e-9
    while hi - lo > 1e-12 and (ends(lo) - ends(hi)).sum() > 4 * len(x):
        half = (lo + hi) / 2
        lo, hi = (half, hi) if below(half) <= rank else (lo, half)
    lo, hi = lo - 1e-13, hi + 1e-13
    first = ends(hi)
    n = ends(lo) - first
    a, at = np.repeat(rows, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h = np.concatenate(((a - down[at]) / (a + down[at]), [-1.0], [v for v, _ in ties]))
    weight = np.concatenate((np.repeat(times, n) * down_times[at], [minus if lo <= -1 else 0], [c if lo <= v < hi else 0 for v, c in ties])).astype(np.int64)
    order = np.argsort(h, kind="stable")
    return float(h[order][np.searchsorted(np.cumsum(weight[order]), rank - below(lo), "right")])


def medcouple_outliers(res: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each residual e is at or above Q75 + 1.5 e^(4 mc) (Q75 - Q25), mc the medcouple. Keys with four residuals or fewer have no outliers.

    The residuals of a key (the edges of one lens) are sorted in one task. Null residuals are no outliers.
    """
    ship_package(res.sparkSession)

    def judge(group: pa.Table) -> pa.Table:
        e = group["e"].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        x = np.sort(e[~np.isnan(e)])
        out = np.zeros(len(e), bool)
        if len(x) > 4:
            low, high = x[int(len(x) * 0.25)], x[int(len(x) * 0.75)]
            out = e >= high + 1.5 * math.exp(4 * medcouple(x)) * (high - low)
        return group.append_column("outlier", pa.array(out))

    return res.groupBy(*keys).applyInArrow(judge, res.drop("outlier").schema.add("outlier", "boolean"))
