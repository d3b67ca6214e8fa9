"""From edge samples to the edge-spread function: 512 bins, 8 a pixel, bin b at (b - 256) / 8 pixels from the edge.

Samples have columns perp (signed distance to the edge), par (along it) and v; keys are the columns that name an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.session import materialise

BINS, PER_PIXEL, CENTRE = 512, 8, 256


def bin_of(perp: Column) -> Column:
    """The bin of a distance; the fraction is cut towards zero."""
    return (perp * PER_PIXEL + CENTRE).cast("int")


def _mid(b: Column) -> Column:
    return (b - CENTRE) / F.lit(float(PER_PIXEL))


def bin_triangular(samples: DataFrame, keys: list[str], reach: int = 5, slope: float = 1.75) -> DataFrame:
    """B1: each sample adds to the bins within reach with a weight that falls by slope a pixel; a bin is the weighted mean."""
    c = bin_of(F.col("perp"))
    near = samples.select(*keys, "perp", "v", F.explode(F.sequence(c - reach, c + reach)).alias("bin"))
    w = F.greatest(F.lit(0.0), 1 - slope * F.abs(F.col("perp") - _mid(F.col("bin"))))
    near = near.withColumn("w", w).where((F.col("w") > 0) & F.col("bin").between(0, BINS - 1))
    return near.groupBy(*keys, "bin").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def pad_missing(esf: DataFrame, keys: list[str]) -> DataFrame:
    """B2: all bins of each edge; a missing one takes the value of the last present bin below, or else of the first above."""
    grid = esf.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    full = grid.join(esf, [*keys, "bin"], "left")
    w = W.partitionBy(*keys).orderBy("bin")
    below = F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return full.select(*keys, "bin", F.coalesce(below, above).alias("v"))


def slopes(esf: DataFrame, keys: list[str], hw: int = 16) -> DataFrame:
    """Least-squares slope over 2 hw + 1 bins; null where they don't all exist."""
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(-hw, hw)
    b = F.col("bin").cast("double")
    squares = hw * (hw + 1) * (2 * hw + 1) / 3
    slope = (F.sum(b * F.col("v")).over(w) - b * F.sum("v").over(w)) / squares
    return esf.select(*keys, "bin", "v", F.when(F.count("*").over(w) == 2 * hw + 1, slope).alias("slope"))


def reject_shifted_peak(slope: DataFrame, keys: list[str], near: int = 16, far: int = 96) -> DataFrame:
    """The steepest bin of each edge, and whether the edge is accepted: not if that lies near to far bins off the centre."""
    steepest = F.max(F.struct(F.abs("slope").alias("s"), (-F.col("bin")).alias("b")))
    peak = slope.where("slope is not null").groupBy(*keys).agg(steepest.alias("m")).select(*keys, (-F.col("m.b")).alias("peak_bin"))
    off = F.abs(F.col("peak_bin") - CENTRE)
    return peak.withColumn("accepted", ~((off > near) & (off < far)))


def transition_width(esf: DataFrame, keys: list[str]) -> DataFrame:
    """Bins nearest to 10 % and 90 % of the smoothed range, the rise between them (pixels, at least 4) and the half width of the transition:
    how far from the centre (bins) either of the two lies when 4 + 2 rise bins are added outwards."""
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(-2, 2)
    smooth = esf.select(*keys, "bin", F.avg("v").over(w).alias("s"))
    whole = W.partitionBy(*keys)
    lo, hi = F.min("s").over(whole), F.max("s").over(whole)
    at = smooth.withColumn("d10", F.abs(F.col("s") - lo - 0.1 * (hi - lo))).withColumn("d90", F.abs(F.col("s") - lo - 0.9 * (hi - lo)))
    found = at.groupBy(*keys).agg(F.min(F.struct(F.round("d10", 6), "bin")).getField("bin").alias("bin10"), F.min(F.struct(F.round("d90", 6), "bin")).getField("bin").alias("bin90"))
    rise = F.greatest(F.lit(4.0), F.abs(F.col("bin90") - F.col("bin10")) / 8.0)
    out = 4 + 2 * F.rint("rise")
    ends = F.greatest(F.abs(F.greatest("bin10", "bin90") + out - CENTRE), F.abs(F.least("bin10", "bin90") - out - CENTRE))
    return found.withColumn("rise", rise).withColumn("half_width", ends.cast("int"))


def snr(samples: DataFrame, esf: DataFrame, keys: list[str], tail: int = 16, half_width: float = 8.0) -> DataFrame:
    """Mean of the tail bins and residual deviation of raw samples against the ESF, outside the transition, by side."""
    ends = esf.groupBy(*keys).agg(F.avg(F.when(F.col("bin") < tail, F.col("v"))).alias("left"), F.avg(F.when(F.col("bin") >= BINS - tail, F.col("v"))).alias("right"))
    far = samples.where(F.abs("perp") > half_width).withColumn("bin", bin_of(F.col("perp")))
    e2 = (F.col("s.v") - F.col("e.v")) ** 2
    joined = far.alias("s").join(esf.alias("e"), [*keys, "bin"])
    spread = joined.groupBy(*keys).agg(F.sqrt(F.avg(F.when(F.col("perp") < 0, e2))).alias("sd_left"), F.sqrt(F.avg(F.when(F.col("perp") > 0, e2))).alias("sd_right"))
    swap = F.col("left") > F.col("right")
    side = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return ends.join(spread, keys).select(*keys, side("left", "right").alias("dark_mean"), side("right", "left").alias("bright_mean"), side("sd_left", "sd_right").alias("dark_sd"), side("sd_right", "sd_left").alias("bright_sd"))


def snr_ratios(s: DataFrame, cap: float = 10_000.0, floor: float = 0.01) -> DataFrame:
    """Contrast and noise ratios, each capped, deviations floored."""
    dark, bright = F.greatest("dark_sd", F.lit(floor)), F.greatest("bright_sd", F.lit(floor))
    contrast = F.col("bright_mean") - F.col("dark_mean")
    cut = lambda x: F.least(x, F.lit(cap))
    return s.withColumns({
        "contrast": contrast, "mean_cnr": cut(contrast / ((dark + bright) / 2)), "dark_cnr": cut(contrast / dark), "bright_cnr": cut(contrast / bright),
        "dark_snr": cut(F.col("dark_mean") / dark), "bright_snr": cut(F.col("bright_mean") / bright)})


def oversampling(samples: DataFrame, keys: list[str], half: float = 4.0) -> DataFrame:
    """Occupied eighth-pixel bins a pixel, over the central pixels."""
    inside = samples.where((F.col("perp") >= -half) & (F.col("perp") < half))
    return inside.groupBy(*keys).agg((F.count_distinct(F.floor(F.col("perp") * PER_PIXEL)) / (2 * half)).alias("oversampling"))


def smooth_tails(esf: DataFrame, keys: list[str], inner: int = 64, width: int = 8) -> DataFrame:
    """A moving average outside the transition, from prefix sums: bins further than inner from the centre take the mean of 2 width + 1 bins, cut at the ends."""
    w = W.partitionBy(*keys).orderBy("bin")
    sums = esf.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    hi = F.coalesce(F.lead("s", width).over(w), F.last("s").over(w.rowsBetween(0, W.unboundedFollowing)))
    lo = F.coalesce(F.lag("s", width + 1).over(w), F.lit(0.0))
    n = F.least(F.col("bin") + width, F.lit(BINS - 1)) - F.greatest(F.col("bin") - width - 1, F.lit(-1))
    return sums.select(*keys, "bin", F.when(F.abs(F.col("bin") - CENTRE) > inner, (hi - lo) / n).otherwise(F.col("v")).alias("v"))


def smooth_gauss(esf: DataFrame, keys: list[str], half: int = 4, end_weight: float = 0.5) -> DataFrame:
    """A short Gaussian whose weight at distance half is end_weight; at the ends of the curve the weights that exist."""
    d = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    near = esf.select(*keys, "v", F.col("bin").alias("src"), d.alias("d")).withColumn("bin", F.col("src") + F.col("d"))
    w = F.pow(F.lit(end_weight), F.col("d") * F.col("d") / float(half * half))
    near = near.where(F.col("bin").between(0, BINS - 1))
    return near.groupBy(*keys, "bin").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def monotone(curve: DataFrame, keys: list[str], at: str = "i", value: str = "v") -> DataFrame:
    """Isotonic regression by the min-max formula: fit(i) is the largest over a <= i of the smallest over b >= i of mean(a..b).

    A self-join of a curve with itself: a curve has a fixed number of points, so its pairs are bounded.
    """
    w = W.partitionBy(*keys).orderBy(at)
    sums = curve.select(*keys, F.row_number().over(w).alias("n"), F.col(at), F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.col(value).alias("v"))
    a = sums.select(*keys, F.col("n").alias("a"), (F.col("s") - F.col("v")).alias("sa"))
    b = sums.select(*keys, F.col("n").alias("b"), F.col("s").alias("sb"))
    means = a.join(b, keys).where("b >= a").select(*keys, "a", "b", ((F.col("sb") - F.col("sa")) / (F.col("b") - F.col("a") + 1)).alias("m"))
    # least over b >= i for each a and i, then the largest over a <= i
    low = means.select(*keys, "a", F.col("b").alias("n"), F.min("m").over(W.partitionBy(*keys, "a").orderBy("b").rowsBetween(0, W.unboundedFollowing)).alias("low"))
    fit = low.groupBy(*keys, "n").agg(F.max("low").alias("fit"))
    return sums.join(fit, [*keys, "n"]).select(*keys, at, "v", "fit")


def lsf(esf: DataFrame, keys: list[str], lo: int = 0, hi: int = BINS - 1) -> DataFrame:
    """The difference of the two neighbours, zero outside the limits and at the ends."""
    w = W.partitionBy(*keys).orderBy("bin")
    d = F.lead("v").over(w) - F.lag("v").over(w)
    return esf.select(*keys, "bin", F.when(F.col("bin").between(lo, hi), F.coalesce(d, F.lit(0.0))).otherwise(F.lit(0.0)).alias("v"))


def lsf_display(esf: DataFrame, keys: list[str]) -> DataFrame:
    """Half the central difference, made positive on the whole, zero at the ends."""
    d = lsf(esf, keys).withColumn("v", F.col("v") / 2)
    sign = F.when(F.sum("v").over(W.partitionBy(*keys)) < 0, -1.0).otherwise(1.0)
    return d.select(*keys, "bin", (F.col("v") * sign + 0.0).alias("v"))


def orient_rising(esf: DataFrame, keys: list[str], ends: int = 16) -> DataFrame:
    """Curves that fall, by a vote of end bins against their mirror, are mirrored."""
    mirror = esf.select(*keys, (BINS - 1 - F.col("bin")).alias("bin"), F.col("v").alias("mv"))
    both = esf.join(mirror, [*keys, "bin"])
    falls = both.where(F.col("bin") < ends).groupBy(*keys).agg((F.count_if(F.col("v") > F.col("mv")) * 2 > F.count("*")).alias("falls"))
    return both.join(falls, keys).select(*keys, "bin", F.when(F.col("falls"), F.col("mv")).otherwise(F.col("v")).alias("v"))


def clip_contaminated(slope: DataFrame, keys: list[str], tolerance: int = 32, inside: DataFrame | None = None) -> DataFrame:
    """B5, one pass: the bins between which an edge is clean: going outwards from bin 16 off the centre, the first at which the slope turns against the
    central one and enough of what lies beyond does too (over 40 % of it and up to a quarter of the central slope, or over 90 % of more than 16 bins).
    inside: keys, left, right of an earlier pass: only bins between them are looked at.
    """
    s = slope.select(*keys, "bin", F.coalesce("slope", F.lit(0.0)).alias("s"))
    if inside is None:
        s = s.withColumns({"left": F.lit(0), "right": F.lit(BINS - 1)})
    else:
        s = s.join(inside.select(*keys, "left", "right"), keys).where(F.col("bin").between(F.col("left"), F.col("right")))
    core = F.when(F.abs(F.col("bin") - CENTRE) <= 16, F.struct(F.round(F.abs("s"), 9).alias("a"), (-F.col("bin")).alias("b"), F.col("s").alias("s")))
    s = s.withColumn("peak", F.max(core).over(W.partitionBy(*keys)).getField("s"))
    against = F.col("s") * F.col("peak") < 0
    size = F.when(against, F.abs("s"))
    left = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    right = W.partitionBy(*keys).orderBy("bin").rowsBetween(0, W.unboundedFollowing)

    def turned(w):
        below, dev, n = F.count(size).over(w), F.max(size).over(w) / F.abs("peak"), F.count("*").over(w)
        return against & (F.abs("s") > F.abs("peak") * 0.001) & (((below > n * 0.4) & (dev > 0.25)) | ((below > 0.9 * n) & (n > 16)))

    t = s.withColumn("l", turned(left)).withColumn("r", turned(right))
    lo = F.max(F.when(F.col("l") & F.col("bin").between(F.col("left") + 4, CENTRE - 16), F.col("bin")))
    hi = F.min(F.when(F.col("r") & F.col("bin").between(CENTRE + 16, F.col("right") - 4), F.col("bin")))
    out = t.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"), F.first("left").alias("left"), F.first("right").alias("right"))
    a, b = F.coalesce("lo", "left"), F.coalesce("hi", "right")
    clipped = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    return out.select(*keys, a.alias("left"), b.alias("right"), clipped.alias("clipped"), (clipped & ((CENTRE - a < tolerance) | (b - CENTRE < tolerance))).alias("contaminated"))


def clip_repeatedly(samples: DataFrame, slope: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """B5 in full: edges that a pass clips are binned anew between their new bounds and looked at again, up to passes times: keys, left, right, clipped, contaminated.

    samples: keys, perp, v; slope: slopes of the curve of all samples. An edge is clipped, or contaminated, if any pass finds it so. Each pass reads the samples of the edges clipped in the one before alone.
    """
    last = materialise(clip_contaminated(slope, keys), "clip-bounds")
    found = last
    for _ in range(passes - 1):
        bounds = last.where("clipped").select(*keys, "left", "right")
        curve = bin_triangular(samples.join(bounds.select(*keys), keys, "left_semi"), keys)
        curve = curve.join(bounds, keys).where(F.col("bin").between(F.col("left"), F.col("right"))).select(*keys, "bin", "v")
        last = materialise(clip_contaminated(slopes(pad_missing(curve, keys), keys), keys, inside=bounds), "clip-bounds")
        now = last.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("left", "right", "contaminated")])
        found = found.join(now, keys, "left").select(*keys, F.coalesce("_left", "left").alias("left"), F.coalesce("_right", "right").alias("right"), "clipped", (F.col("contaminated") | F.coalesce("_contaminated", F.lit(False))).alias("contaminated"))
    return found


#: The kernel's rate, and the widths of core and shoulder relative to the transition.
ALPHA, CORE, SHOULDER = 13.0, 0.5, 1.85


def kernel(x: Column, rate: Column) -> Column:
    """An exponential, averaged over a sixteenth of a pixel on both sides."""
    c = F.lit(1 / 16)
    norm = 1 - F.exp(-rate * c)
    return F.when(F.abs(x) < c, (2 - 2 * F.exp(-rate * c) * F.cosh(rate * x)) / (2 * F.sinh(rate * c) * norm)).otherwise(F.exp(-rate * F.abs(x)) / norm)


def esf_kernel(samples: DataFrame, width: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """Bins by kernel smoothing: the kernel in the core, ever wider kernels in the shoulders, a box in the tails. width: keys, half_width in bins."""
    c = bin_of(F.col("perp"))
    off = F.abs(c - CENTRE)
    t = F.col("half_width")
    n = F.when(off > 2 * CORE * t, 12).when(off > CORE * t, 7).otherwise(5)
    s = samples.join(width.select(*keys, "half_width"), keys).withColumn("lo", F.greatest(F.lit(0), c - n)).withColumn("hi", F.least(F.lit(BINS - 1), c + n)).where("lo <= hi")
    b = s.withColumn("bin", F.explode(F.sequence("lo", "hi")))
    far = F.abs(F.col("bin") - CENTRE)
    box = (F.col("hi") < CENTRE - SHOULDER * t) | (F.col("lo") > CENTRE + SHOULDER * t) | (far >= SHOULDER * t)
    share = (far / t - CORE) / (SHOULDER - CORE)
    rate = F.when(far < t * CORE, F.lit(alpha)).otherwise(alpha * (1 - share + 0.01 * share))
    w = F.when(box, 1.0).otherwise(kernel(F.col("perp") - _mid(F.col("bin")), rate))
    b = b.withColumn("w", w)
    return b.groupBy(*keys, "bin").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def tail_fill(esf: DataFrame, keys: list[str], inner: int = 24) -> DataFrame:
    """Missing ends take the mean of the outermost present bins, inner of them a side; gaps inside are interpolated from neighbours by position."""
    grid = esf.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    w = W.partitionBy(*keys).orderBy("bin")
    up, down = F.row_number().over(w), F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("bin")))
    r = esf.withColumn("u", up).withColumn("d", down)
    ends = r.groupBy(*keys).agg(F.avg(F.when((F.col("u") <= inner) & (F.col("bin") < CENTRE), F.col("v"))).alias("lv"), F.avg(F.when((F.col("d") <= inner) & (F.col("bin") > CENTRE), F.col("v"))).alias("rv"), F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    j = grid.join(esf, [*keys, "bin"], "left").join(ends, keys)
    at = F.when(F.col("v").isNotNull(), F.struct("bin", "v"))
    j = j.withColumn("p", F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("q", F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    inside = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("bin") - F.col("p.bin")) / F.greatest(F.col("q.bin") - F.col("p.bin"), F.lit(1))
    return j.select(*keys, "bin", F.when(F.col("bin") < F.col("b0"), F.col("lv")).when(F.col("bin") > F.col("b1"), F.col("rv")).otherwise(F.coalesce("v", inside)).alias("v"))


def lut_interp(df: DataFrame, lut: list[tuple[float, float]], x: str, to: str) -> DataFrame:
    """A piecewise-linear lookup with its ends held; the table is a short fixed list, so it becomes one expression."""
    out = F.lit(lut[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(lut, lut[1:]))):
        out = F.when(F.col(x) < x1, y0 + (F.col(x) - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return df.withColumn(to, F.when(F.col(x) <= lut[0][0], F.lit(lut[0][1])).otherwise(out))
