"""Reports over measured edges: rows with edge_id, image_id, ex, ey, angle, mtf, quality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.session import materialise


def rank_pick(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Order statistics at place floor(n q), counted from 0, without interpolation: one row for each key and q.

    Values are counted first, so a window holds a key's distinct values, not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("_hi", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q")
    at = F.least(F.floor(F.col("_all") * F.col("q")), F.col("_all") - 1)
    return run.select("*", q).where((at < F.col("_hi")) & (at >= F.col("_hi") - F.col("_n"))).select(*keys, "q", F.col(value).alias("value"), F.col("_all").alias("n"))


def quantile_stats(m: DataFrame, qs=(0.05, 0.25, 0.5, 0.75, 0.95), value: str = "mtf") -> DataFrame:
    """Order statistics by image, of all edges and of those of quality 0.5 or more; the value 1.0 counts as missing."""
    m = m.where(F.col(value) != 1.0)
    kinds = F.explode(F.when(F.col("quality") >= 0.5, F.array(F.lit("all"), F.lit("good"))).otherwise(F.array(F.lit("all")))).alias("population")
    return rank_pick(m.select("image_id", kinds, value), ["image_id", "population"], value, list(qs))


def radial_angle(m: DataFrame) -> DataFrame:
    """R2: degrees between an edge's normal and the ray from the image's mean centre."""
    w = W.partitionBy("image_id")
    dx, dy = F.col("ex") - F.avg("ex").over(w), F.col("ey") - F.avg("ey").over(w)
    a = F.radians("angle")
    cos = F.abs(dx * F.cos(a) + dy * F.sin(a)) / F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    return m.withColumn("radial_angle", F.degrees(F.acos(F.least(F.lit(1.0), cos))))


def classify_ms(m: DataFrame, cx: float, cy: float, near: float = 45.0, far: float = 45.0) -> DataFrame:
    """Meridional if the normal is within near degrees of the radius, sagittal beyond far, others dropped."""
    dx, dy, a = F.col("ex") - cx, F.col("ey") - cy, F.radians("angle")
    cos = F.abs(dx * F.cos(a) + dy * F.sin(a)) / F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    kind = F.when(cos > math.cos(math.radians(near)), "meridional").when(cos <= math.cos(math.radians(far)), "sagittal")
    return m.withColumn("direction", kind).where("direction is not null")


def grid_composite(m: DataFrame, cell: float, value: str = "mtf") -> DataFrame:
    """The value of largest size in each cell and direction."""
    best = F.max(F.struct(F.abs(value).alias("a"), F.col(value).alias("v"))).getField("v")
    return m.groupBy("image_id", "direction", F.rint(F.col("ey") / cell).cast("int").alias("gy"), F.rint(F.col("ex") / cell).cast("int").alias("gx")).agg(best.alias("v"))


def percentile_bounds(m: DataFrame, value: str = "mtf", least: int = 20) -> DataFrame:
    """The order statistics at 5 and 97 per cent of each image with enough values."""
    picked = rank_pick(m, ["image_id"], value, [0.05, 0.97]).where(F.col("n") >= least)
    return picked.groupBy("image_id").agg(F.max(F.when(F.col("q") == 0.05, F.col("value"))).alias("low"), F.max(F.when(F.col("q") == 0.97, F.col("value"))).alias("high"))


def fill_empty_knots(occupied: DataFrame, ny: int, nx: int) -> DataFrame:
    """Each empty knot of an ny x nx grid takes the value of the nearest occupied one (city blocks); of equals the largest value."""
    grid = occupied.select("image_id").distinct().withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    other = occupied.select("image_id", F.col("gy").alias("oy"), F.col("gx").alias("ox"), "v")
    d = F.abs(F.col("gy") - F.col("oy")) + F.abs(F.col("gx") - F.col("ox"))
    best = F.min(F.struct(d.alias("d"), (-F.col("v")).alias("nv")))
    return grid.join(other, "image_id").groupBy("image_id", "gy", "gx").agg(best.alias("b")).select("image_id", "gy", "gx", (-F.col("b.nv")).alias("v"), F.col("b.d").alias("distance"))


def bilinear_upsample(grid: DataFrame, factor: int) -> DataFrame:
    """A grid made finer by a whole factor; cells at the border take what neighbours there are."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = grid.select("image_id", F.col("gy").alias("cy"), F.col("gx").alias("cx")).withColumn("sy", F.explode(steps)).withColumn("sx", F.explode(steps))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    fine = fine.withColumn("c", F.explode(corners))
    ty, tx = F.col("sy") / float(factor), F.col("sx") / float(factor)
    w = F.when(F.col("c.a") == 1, ty).otherwise(1 - ty) * F.when(F.col("c.b") == 1, tx).otherwise(1 - tx)
    fine = fine.select("image_id", (F.col("cy") * factor + F.col("sy")).alias("fy"), (F.col("cx") * factor + F.col("sx")).alias("fx"), (F.col("cy") + F.col("c.a")).alias("gy"), (F.col("cx") + F.col("c.b")).alias("gx"), w.alias("w")).where("w > 0")
    j = fine.join(grid, ["image_id", "gy", "gx"])
    return j.groupBy("image_id", "fy", "fx").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def lens_profile(m: DataFrame, cx: float, cy: float, quality: float = 0.3) -> DataFrame:
    """The value against the radius, by direction (within 15 degrees, beyond 75), for valid edges."""
    m = classify_ms(m.where((F.col("mtf") < 1) & (F.col("quality") > quality)), cx, cy, 15, 75)
    return m.withColumn("radius", F.sqrt((F.col("ex") - cx) ** 2 + (F.col("ey") - cy) ** 2)).select("image_id", "edge_id", "direction", "radius", "mtf")


def local_linear(points: DataFrame, keys: list[str], x: str, y: str, n: int, lo: float, hi: float, reach: float) -> DataFrame:
    """Tricube-weighted local lines at n places from lo to hi, from moment sums; places with fewer than 3 points are left out.

    Points are filed by the places in their reach, so each meets a bounded number of places.
    """
    step = (hi - lo) / (n - 1)
    first = F.ceil((F.col(x) - reach - lo) / step).cast("int")
    last = F.floor((F.col(x) + reach - lo) / step).cast("int")
    near = points.where(first <= last).withColumn("i", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))))).where(F.col("i").between(0, n - 1))
    u = F.col(x) - (lo + F.col("i") * step)
    near = near.withColumn("u", u).withColumn("w", F.pow(1 - F.pow(F.abs(u) / reach, 3.0), 3.0)).where("w > 0")
    s = lambda e: F.sum(F.col("w") * e)
    sums = near.groupBy(*keys, "i").agg(F.count("*").alias("n"), F.sum("w").alias("s0"), s(F.col("u")).alias("s1"), s(F.col("u") ** 2).alias("s2"), s(F.col(y)).alias("t0"), s(F.col("u") * F.col(y)).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") ** 2
    value = F.when(det > 1e-9, (F.col("t0") * F.col("s2") - F.col("t1") * F.col("s1")) / det).otherwise(F.col("t0") / F.col("s0"))
    return sums.where("n >= 3").select(*keys, (F.lit(lo) + F.col("i") * step).alias("x"), value.alias("y"))


def profile_points(m: DataFrame, sfr: DataFrame, keys: list[str], cx: float, cy: float, freqs: list[float], quality: float = 0.3) -> DataFrame:
    """The contrast of each valid edge at up to three frequencies against the radius: image_id, direction, freq, radius, contrast.

    m: keys (image_id among them), ex, ey, angle, mtf, quality; sfr: keys, k, m. Meridional within 15 degrees, sagittal beyond 75.
    """
    from acutance.operators.spectrum import contrast_at

    if not 1 <= len(freqs) <= 3:
        raise ValueError("one to three frequencies")
    at = classify_ms(m.where((F.col("mtf") < 1) & (F.col("quality") > quality)), cx, cy, 15, 75).withColumn("radius", F.hypot(F.col("ex") - cx, F.col("ey") - cy))
    at = at.select(*keys, "direction", "radius")
    parts = [at.join(contrast_at(sfr, keys, f), keys).select("image_id", "direction", F.lit(float(f)).alias("freq"), "radius", "contrast") for f in freqs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def local_poly(points: DataFrame, keys: list[str], x: str, y: str, n: int = 64, sparse: bool = False, least: int = 20) -> DataFrame:
    """A local polynomial at n places over the points' span: keys, i, x, y.

    Third order, but second in the outer fifths and where a key has fewer than 80 points with its mirrored ends: five points at each end
    stand again 1 % of the span farther out, and their neighbours 1.5 %. The weight is tricube over a fifth of the span. With sparse, places with fewer
    than least points reach for the next ones on both sides, and each point weighs a quarter more. Keys need six points and a span above
    0; places whose equations have no solution are left out. Points are joined to the places by their rank, so a place
    meets its own points alone; the sums' small solves go by batches.
    """
    own = W.partitionBy(*keys)
    p = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    order = own.orderBy("_x", "_y")
    p = p.withColumns({"_n": F.count("*").over(own), "_lo": F.min("_x").over(own), "_hi": F.max("_x").over(own), "_i": F.row_number().over(order), "_next": F.lead("_y").over(order), "_before": F.lag("_y").over(order)})
    p = p.where("_n >= 6 and _hi > _lo").withColumn("_span", F.col("_hi") - F.col("_lo"))
    copy = lambda at, value: F.struct(at.alias("x"), value.alias("y"))
    start = F.array(copy(F.col("_x") - 0.01 * F.col("_span"), F.col("_y")), copy(F.col("_x") - 0.015 * F.col("_span"), F.col("_next")))
    end = F.array(copy(F.col("_x") + 0.01 * F.col("_span"), F.col("_y")), copy(F.col("_x") + 0.015 * F.col("_span"), F.col("_before")))
    nothing = F.array().cast("array<struct<x:double,y:double>>")
    here = F.concat(F.array(copy(F.col("_x"), F.col("_y"))), F.when(F.col("_i") <= 5, start).otherwise(nothing), F.when(F.col("_i") > F.col("_n") - 5, end).otherwise(nothing))
    p = p.select(*keys, "_lo", "_span", F.inline(here)).withColumn("_rank", F.row_number().over(own.orderBy("x", "y")) - 1).withColumn("_all", F.count("*").over(own))
    p = materialise(p, "profile-points")
    frame = p.groupBy(*keys).agg(F.first("_lo").alias("_lo"), F.first("_span").alias("_span"), F.first("_all").alias("_all"))
    place = frame.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_mid", F.col("_lo") + (F.col("i") - 0.5) * F.col("_span") / (n - 2))
    # How many points lie before each end of a place's reach: points and ends in one order.
    ends = place.select(*keys, F.col("i"), F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("_mid") - F.col("_span") / 5).alias("x")), F.struct(F.lit(1).alias("side"), (F.col("_mid") + F.col("_span") / 5).alias("x")))).alias("e"))
    both = ends.select(*keys, "i", "e.side", "e.x").unionByName(p.select(*keys, F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("side"), "x"))
    counted = both.withColumn("c", F.count(F.when(F.col("side").isNull(), 1)).over(own.orderBy("x", F.col("side").isNull()).rowsBetween(W.unboundedPreceding, 0))).where("side is not null")
    reach = counted.groupBy(*keys, "i").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("b"))
    place = place.join(reach, [*keys, "i"])
    if sparse:
        wider = lambda s, _: F.when(s["b"] - s["a"] < least, F.struct(F.greatest(s["a"] - 1, F.lit(0)).alias("a"), F.least(s["b"] + 1, F.col("_all")).alias("b"))).otherwise(s)
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(least)), F.struct(F.col("a").alias("a"), F.col("b").alias("b")), wider)
        place = place.withColumn("r", F.when(F.col("_all") > least, grown).otherwise(F.struct("a", "b"))).withColumns({"a": F.col("r.a"), "b": F.col("r.b")})
    near = place.where("b > a").select(*keys, "i", "_mid", F.explode(F.sequence(F.col("a").cast("int"), (F.col("b") - 1).cast("int"))).alias("_rank"))
    j = near.join(p, [*keys, "_rank"])
    u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") - F.col("_mid")) / F.col("_span")))
    cube = F.pow(F.abs(u) * 5, F.lit(3.0))
    w = F.when(F.abs(u) < 0.2, F.pow(1 - cube, F.lit(3.0))).otherwise(0.0) + (0.25 if sparse else 0.0)
    j = j.select(*keys, "i", "_mid", "_all", u.alias("u"), (w * w).alias("w"), "y")
    sums = j.groupBy(*keys, "i", "_mid", "_all").agg(*[F.sum(F.col("w") * F.pow("u", F.lit(float(k)))).alias(f"s{k}") for k in range(7)], *[F.sum(F.col("w") * F.pow("u", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(4)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def solve(batches):
        for b in batches:
            outer = (b["i"] < 0.2 * n) | (b["i"] >= 0.8 * n) | (b["_all"] < 80)
            value = np.full(len(b), np.nan)
            for size in (3, 4):
                at = np.flatnonzero(outer == (size == 3))
                r = np.arange(size)
                a = b[[f"s{k}" for k in range(7)]].to_numpy()[at][:, r[:, None] + r[None, :]]
                z = b[[f"t{k}" for k in range(size)]].to_numpy()[at]
                sound = np.linalg.eigvalsh(a)[:, 0] > 1e-14 * np.maximum(a[:, 0, 0], 1e-300) if len(at) else np.zeros(0, bool)
                value[at[sound]] = np.linalg.solve(a[sound], z[sound][:, :, None])[:, 0, 0]
            yield b.assign(x=b["_mid"], y=value)[[*keys, "i", "x", "y"]][np.isfinite(value)]

    return sums.mapInPandas(solve, f"{fields}, i int, x double, y double")


def row_maxima(m: DataFrame, transpose: bool = False) -> DataFrame:
    """The largest value in each rounded row among near-horizontal edges (30 degrees) of quality 0.5 or more."""
    a = F.abs(F.col("angle") % 180)
    level = (a <= 30) | (a >= 150)
    at = F.rint("ex" if transpose else "ey").cast("int")
    return m.where((~level if transpose else level) & (F.col("quality") >= 0.5)).groupBy("image_id", at.alias("at")).agg(F.max("mtf").alias("mtf"))


def median5(curve: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The centred median of at most five neighbours, the upper of two middle ones."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(-2, 2)
    a = F.sort_array(F.collect_list(value).over(w))
    return curve.select(*keys, at, F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1).alias(value))


def robust_max(rows: DataFrame, keys: list[str], value: str = "mtf") -> DataFrame:
    """The order statistic at 98 per cent, divided by 0.9."""
    return rank_pick(rows, keys, value, [0.98]).select(*keys, (F.col("value") / 0.9).alias("robust_max"))


def profile_peak(m: DataFrame) -> DataFrame:
    """In each image, the edge nearest to the centre of all others than the strongest one, and its value."""
    top = m.groupBy("image_id").agg(F.max(F.struct("mtf", "edge_id")).getField("edge_id").alias("top"))
    rest = m.join(top, "image_id").where("edge_id <> top")
    centre = rest.groupBy("image_id").agg(F.avg("ex").alias("cx"), F.avg("ey").alias("cy"))
    d = F.sqrt((F.col("ex") - F.col("cx")) ** 2 + (F.col("ey") - F.col("cy")) ** 2)
    best = rest.join(centre, "image_id").groupBy("image_id").agg(F.min(F.struct(F.round(d, 6).alias("d"), "edge_id", "mtf")).alias("b"))
    return best.select("image_id", F.col("b.edge_id").alias("edge_id"), F.col("b.d").alias("distance"), F.col("b.mtf").alias("mtf"))


def reference_edge(m: DataFrame, areas: DataFrame, curve: DataFrame, along: str = "ey", good: float = 0.5) -> DataFrame:
    """In each image, the side of the largest block that is nearest to the middle of the other blocks, set against the image's profile curve.

    m: image_id, block_id, edge_id, ex, ey, mtf, quality; areas: image_id, block_id, area; curve: image_id, at, value, along the same direction. Columns: position of the edge along it;
    shift from the curve's highest place; on_curve, the curve's value at the place nearest to the edge; mtf, the edge's own value, or the curve's highest where its quality is not
    good. Blocks of equal area go by the smaller id, as do edges and places at equal distance. An image of one block has no other: then its edge of the smallest id counts. Images without a curve have no rows.
    """
    best = areas.groupBy("image_id").agg(F.min(F.struct((-F.col("area")).alias("a"), "block_id")).getField("block_id").alias("_top"))
    centres = m.groupBy("image_id", "block_id").agg(F.avg("ex").alias("x"), F.avg("ey").alias("y")).join(best, "image_id").where("block_id <> _top")
    middle = centres.groupBy("image_id").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    own = m.join(best, "image_id").where("block_id = _top").join(middle, "image_id", "left")
    d = F.coalesce(F.round(F.hypot(F.col("ex") - F.col("_mx"), F.col("ey") - F.col("_my")), 6), F.lit(0.0))
    e = own.groupBy("image_id").agg(F.min(F.struct(d.alias("d"), "edge_id", F.col(along).alias("position"), "mtf", "quality", "block_id")).alias("e"))
    e = e.select("image_id", "e.block_id", "e.edge_id", "e.position", "e.mtf", "e.quality")
    j = curve.select("image_id", F.col("at").cast("double").alias("at"), "value").where("value is not null").join(e, "image_id")
    gap = F.round(F.abs(F.col("at") - F.col("position")), 9)
    j = j.groupBy("image_id", "block_id", "edge_id", "position", "mtf", "quality").agg(F.min(F.struct((-F.col("value")).alias("v"), "at")).alias("h"), F.min(F.struct(gap.alias("g"), "at", "value")).alias("c"))
    fine = F.col("quality") >= good
    own_value = F.when(fine, F.col("mtf")).otherwise(-F.col("h.v"))
    return j.select("image_id", "block_id", "edge_id", "position", (F.col("position") - F.col("h.at")).alias("shift"), F.col("c.value").alias("on_curve"), own_value.alias("mtf"), F.coalesce(fine, F.lit(False)).alias("good"))


def channel_shift(lsf: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid of each channel's line spread (bin, v), less that of green, in pixels."""
    c = lsf.groupBy(*keys, "channel").agg((F.sum(F.col("bin") * F.abs("v")) / F.sum(F.abs("v")) / 8).alias("c"))
    green = c.where("channel = 1").select(*keys, F.col("c").alias("g"))
    shift = F.col("c") - F.col("g")
    return c.where("channel <> 1").join(green, keys).groupBy(*keys).agg(F.max(F.when(F.col("channel") == 0, shift)).alias("red_px"), F.max(F.when(F.col("channel") == 2, shift)).alias("blue_px"))


def ca_percent(m: DataFrame, cx: float, cy: float) -> DataFrame:
    """Shift as per cent of the radius, of one pixel at least."""
    r = F.greatest(F.lit(1.0), F.sqrt((F.col("ex") - cx) ** 2 + (F.col("ey") - cy) ** 2))
    return m.withColumn("red_pct", 100 * F.col("red_px") / r).withColumn("blue_pct", 100 * F.col("blue_px") / r)


def nearest_edge(points: DataFrame, m: DataFrame, most: float = 50.0) -> DataFrame:
    """The closest edge to each point within most pixels; of equals the smallest id. Both are filed by tiles of that size."""
    tile = lambda c: F.floor(F.col(c) / most).cast("int")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = points.withColumn("ty", F.explode(F.transform(around, lambda o: tile("py") + o))).withColumn("tx", F.explode(F.transform(around, lambda o: tile("px") + o)))
    e = m.select("image_id", "edge_id", "ex", "ey", tile("ey").alias("ty"), tile("ex").alias("tx"))
    d = F.sqrt((F.col("px") - F.col("ex")) ** 2 + (F.col("py") - F.col("ey")) ** 2)
    near = p.join(e, ["image_id", "ty", "tx"]).withColumn("d", d).where(F.col("d") <= most)
    return near.groupBy("image_id", "point_id").agg(F.min(F.struct(F.round("d", 6).alias("d"), "edge_id")).alias("b")).select("image_id", "point_id", F.col("b.edge_id").alias("edge_id"), F.col("b.d").alias("distance"))


def match_captures(a: DataFrame, b: DataFrame, most: float = 50.0) -> DataFrame:
    """Edges of two captures that are each other's nearest within most pixels, with the change of the value."""
    pts = lambda m: m.select("image_id", F.col("edge_id").alias("point_id"), F.col("ex").alias("px"), F.col("ey").alias("py"))
    ab = nearest_edge(pts(a), b, most).select("image_id", F.col("point_id").alias("a"), F.col("edge_id").alias("b"))
    ba = nearest_edge(pts(b), a, most).select("image_id", F.col("edge_id").alias("a"), F.col("point_id").alias("b"))
    both = ab.join(ba, ["image_id", "a", "b"])
    ma, mb = a.select("image_id", F.col("edge_id").alias("a"), F.col("mtf").alias("ma")), b.select("image_id", F.col("edge_id").alias("b"), F.col("mtf").alias("mb"))
    return both.join(ma, ["image_id", "a"]).join(mb, ["image_id", "b"]).select("image_id", "a", "b", (F.col("mb") - F.col("ma")).alias("delta"))


def accuracy_summary(m: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median absolute difference of measured and expected, by keys."""
    e = F.abs(F.col("measured") - F.col("expected"))
    return m.groupBy(*keys).agg(F.avg(e).alias("mean_abs"), F.percentile(e, 0.5).alias("median_abs"), F.count("*").alias("n"))


def relative_error_p95(m: DataFrame, keys: list[str]) -> DataFrame:
    """The 95th percentile of the relative error in per cent, by keys."""
    return m.groupBy(*keys).agg(F.percentile(F.abs(100 * (F.col("measured") - F.col("expected")) / F.col("expected")), 0.95).alias("p95"))


def reduce_angle(theta: Column) -> Column:
    """Q-17: an angle in radians, modulo 90 degrees, folded to 0 .. 45, in degrees."""
    d = F.degrees(F.abs(theta % (math.pi / 2)))
    return F.when(d > 45, 90 - d).otherwise(d)


def spread_band(points: DataFrame, fit: DataFrame, keys: list[str], n: int = 64, share: float = 0.9, reach: int = 2, alpha: float = 0.35) -> DataFrame:
    """The order statistic of |y - fit| among points within reach places, gaps filled linearly, then smoothed exponentially forwards and backwards.

    points: keys, i (place), e (absolute residual); fit: keys, i. The band of a key is an array of n places.
    """
    near = points.withColumn("i", F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach))).where(F.col("i").between(0, n - 1))
    picked = rank_pick(near.select(*keys, "i", F.round("e", 9).alias("e")), [*keys, "i"], "e", [share]).select(*keys, "i", "value")
    grid = fit.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = W.partitionBy(*keys).orderBy("i")
    j = grid.join(picked, [*keys, "i"], "left")
    at = F.when(F.col("value").isNotNull(), F.struct("i", "value"))
    j = j.withColumn("p", F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("q", F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    line = F.col("p.value") + (F.col("q.value") - F.col("p.value")) * (F.col("i") - F.col("p.i")) / F.greatest(F.col("q.i") - F.col("p.i"), F.lit(1))
    j = j.select(*keys, "i", F.coalesce("value", line, F.col("p.value"), F.col("q.value")).alias("v"))
    a = j.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("a"))
    run = lambda x: F.expr(f"aggregate({x}, cast(array() as array<double>), (s, v) -> array_append(s, if(size(s) = 0, v, {alpha}D * v + {1 - alpha}D * s[size(s) - 1])))")
    a = a.withColumn("f", run("a")).withColumn("b", F.reverse(run("reverse(f)")))
    return a.select(*keys, F.posexplode("b").alias("i", "band"))


def smooth_profile(curve: DataFrame, keys: list[str], at: str = "i", value: str = "y") -> DataFrame:
    """The parabola through 15 neighbouring points, at the middle one; the seven points at each end stay."""
    from acutance.operators.spectrum import smoothing_weights

    w = W.partitionBy(*keys).orderBy(at)
    taps = smoothing_weights(7)
    near = lambda d: F.lag(value, -d).over(w) if d < 0 else (F.col(value) if d == 0 else F.lead(value, d).over(w))
    total = sum((taps[d + 7] * near(d) for d in range(-7, 8)), F.lit(0.0))
    return curve.select(*keys, at, F.coalesce(total, F.col(value)).alias(value))


def is_rotated(rm: DataFrame, bins: int = 60) -> DataFrame:
    """Whether a picture's row maxima look like a rotated chart: of all two breakpoints, those with the least spread of the three parts
    (interquartile range, the middle part counted ten times) are taken; the middle's median is then not above both ends'.

    A picture has a fixed number of bins, so its pairs of breakpoints are bounded.
    """
    b = rm.withColumn("lo", F.min("at").over(W.partitionBy("image_id"))).withColumn("hi", F.max("at").over(W.partitionBy("image_id")))
    b = b.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("at") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("int")))
    b = b.groupBy("image_id", "bin").agg(F.max("mtf").alias("m"))
    cuts = b.select("image_id").distinct().withColumn("p", F.explode(F.sequence(F.lit(bins // 6), F.lit(bins // 2), F.lit(2)))).withColumn("q", F.explode(F.sequence(F.lit(bins // 2 + 2), F.lit(bins - bins // 6), F.lit(2))))
    part = F.when(F.col("bin") < F.col("p"), 0).when(F.col("bin") < F.col("q"), 1).otherwise(2)
    s = b.join(cuts, "image_id").withColumn("part", part)
    s = s.groupBy("image_id", "p", "q", "part").agg(F.percentile("m", 0.25).alias("a"), F.percentile("m", 0.5).alias("b"), F.percentile("m", 0.75).alias("c"))
    g = s.groupBy("image_id", "p", "q").agg(F.count("*").alias("n"), F.sum((F.col("c") - F.col("a")) * F.when(F.col("part") == 1, 10).otherwise(1)).alias("cost"), *[F.max(F.when(F.col("part") == i, F.col("b"))).alias(f"m{i}") for i in range(3)]).where("n = 3")
    best = g.groupBy("image_id").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "p", "q", "m0", "m1", "m2")).alias("s"))
    return best.select("image_id", "s.p", "s.q", ((F.col("s.m1") <= F.col("s.m0")) & (F.col("s.m1") <= F.col("s.m2"))).alias("rotated"))


def loess_auto(curve: DataFrame, keys: list[str], at: str, value: str, widths=(5, 8, 11, 14, 17, 20), most: float = 0.05) -> DataFrame:
    """Local lines over growing half widths; the smallest width at which the fit's direction changes at fewer than 5 % of the points, else the widest."""
    rows = curve.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(at)).cast("double"))
    out = None
    for h in widths:
        w = W.partitionBy(*keys).orderBy("n").rowsBetween(-h, h)
        c, sn, sy, snn, sny = F.count("*").over(w), F.sum("n").over(w), F.sum(value).over(w), F.sum(F.col("n") * F.col("n")).over(w), F.sum(F.col("n") * F.col(value)).over(w)
        det = c * snn - sn * sn
        slope = F.when(det > 0, (c * sny - sn * sy) / F.nullif(det, F.lit(0.0))).otherwise(0.0)
        f = rows.withColumn("fit", (sy - slope * sn) / c + slope * F.col("n"))
        step = F.round(F.col("fit") - F.lag("fit").over(W.partitionBy(*keys).orderBy("n")), 9)
        f = f.withColumn("d", F.signum(step)).withColumn("turn", ((F.col("d") * F.lag("d").over(W.partitionBy(*keys).orderBy("n"))) < 0).cast("int"))
        f = f.select(*keys, at, "fit", "turn", F.lit(h).alias("width"))
        out = f if out is None else out.unionByName(f)
    rate = out.groupBy(*keys, "width").agg(F.avg(F.coalesce("turn", F.lit(0))).alias("rate"))
    pick = rate.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("rate") < most, F.col("width"))), F.max("width")).alias("width"))
    return out.join(pick, [*keys, "width"]).select(*keys, at, "width", "fit")


def ca_surface(m: DataFrame, cell: float, value: str, least: int = 6, limit: float = 16.0) -> DataFrame:
    """The cells of a shift within the limit, for images with at least six edges; ca_map fits the surface."""
    enough = m.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("image_id")
    return grid_composite(m.join(enough, "image_id", "left_semi").where(F.abs(value) <= limit), cell, value)


def ca_map(m: DataFrame, width: float, height: float, cell: float, value: str, unit: str = "px", pixel_um: float = 1.0, sparse: bool = False, step: int = 5, least: int = 6) -> DataFrame:
    """The surface of a shift over the picture, by direction: R4, R6, R7, R8. m: image_id, direction, ex, ey, the shift in pixels.

    unit: px, um (pixel_um each) or percent of the radius (100 pixels at least). Shifts of 16 pixels or more are left out. The surface keeps to
    the values of the cells it is fitted to; a sparse chart is smoothed more and reaches one knot farther.
    """
    from acutance.operators.targets import surface_eval, surface_fit

    radius = F.hypot(F.col("ex") - width / 2, F.col("ey") - height / 2)
    scale = {"px": F.lit(1.0), "um": F.lit(float(pixel_um)), "percent": 100 / F.greatest(F.lit(100.0), radius)}[unit]
    shifts = m.where(F.abs(value) < 16).withColumn("_shift", F.col(value) * scale)
    keys = ["image_id", "direction"]
    cells = ca_surface(shifts, cell, "_shift", least, float("inf")).select(*keys, "gy", "gx", "v")
    prune = 3 if sparse else 2
    fit = surface_fit(cells, keys, smooth=0.1 if sparse else 0.01, rows=int(height // cell) + 1, columns=int(width // cell) + 1, prune=prune)
    ends = cells.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = surface_eval(fit, keys, step, prune).join(ends, keys)
    return at.select(*keys, (F.col("gy") * cell).alias("y"), (F.col("gx") * cell).alias("x"), F.greatest("lo", F.least("hi", "v")).alias("v"))
