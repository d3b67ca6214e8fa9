"""Pixel tables: projections and filters, histograms, neighbourhoods. Pixels have image_id, y, x, v (and channel where given)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from acutance.session import broadcast_if_small

FULL = 65535.0
#: The sRGB tone curve as seven parameters, and the luminance weights of red, green and blue.
SRGB = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045, 0.0, 0.0)
LUMINANCE = (0.2126, 0.7152, 0.0722)


def linearise(px: DataFrame, params=SRGB) -> DataFrame:
    """The parametric tone curve on 16-bit samples, rounded to 16 bits."""
    g, a, b, c, d, e, f = params
    x = F.col("v") / FULL
    y = F.when(x < d, c * x + f).otherwise(F.pow(x * a + b, F.lit(g)) + e)
    return px.withColumn("v", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) * FULL).cast("int"))


def linearise_table(px: DataFrame, knots: DataFrame) -> DataFrame:
    """A piecewise-linear curve through the knots (x, y); values outside take the nearest knot. The knots of a tone curve are at most 65536."""
    w = W.orderBy("x")
    seg = knots.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("n"))
    first = (F.col("n") == 1) & (F.col("v") < F.col("x0"))
    inside = (F.col("v") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("v") < F.col("x1")))
    y = F.when(first | F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("v") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return px.join(broadcast_if_small(seg), first | inside).select(*px.drop("v").columns, F.rint(y).cast("int").alias("v"))


def widen_8bit(px: DataFrame) -> DataFrame:
    """8-bit samples as 16-bit ones."""
    return px.withColumn("v", F.shiftleft("v", 8))


def luminance(px: DataFrame, weights=LUMINANCE) -> DataFrame:
    """P5: weighted sum over channels 0, 1, 2, rounded half up."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("channel") + 1)
    return px.where(F.col("channel").between(0, 2)).groupBy("image_id", "y", "x").agg((F.sum(F.col("v") * w) + 0.5).cast("int").alias("v"))


def linear_rgb(px: DataFrame) -> DataFrame:
    """Every channel linear, channels not mixed."""
    return linearise(px.where(F.col("channel").between(0, 2)))


def pad_border(px: DataFrame, images: DataFrame, n: int) -> DataFrame:
    """A frame of n pixels with the image's maximum; coordinates move by n. images: image_id, width, height."""
    top = px.groupBy("image_id").agg(F.max("v").alias("v"))
    rows = images.join(top, "image_id")
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") + 2 * n - 1)))
    inside = F.col("y").between(n, F.col("height") + n - 1)
    left, right = F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.col("width") + n, F.col("width") + 2 * n - 1)
    whole = F.sequence(F.lit(0), F.col("width") + 2 * n - 1)
    frame = rows.withColumn("x", F.explode(F.when(inside, F.concat(left, right)).otherwise(whole))).select("image_id", "y", "x", "v")
    return px.select("image_id", (F.col("y") + n).alias("y"), (F.col("x") + n).alias("x"), "v").unionByName(frame)


def invert(px: DataFrame) -> DataFrame:
    """2^k - 1 - v with 2^k the power of two not below the image's maximum, k at least 1; never below 0."""
    top = px.groupBy("image_id").agg(F.pow(F.lit(2.0), F.greatest(F.lit(1.0), F.ceil(F.log2(F.max("v"))))).cast("int").alias("p"))
    return px.join(top, "image_id").select("image_id", "y", "x", F.greatest(F.lit(0), F.col("p") - 1 - F.col("v")).alias("v"))


def crop(px: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pixels inside the bounds (y0, y1, x0, x1, both ends included), moved to the origin."""
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    return px.join(bounds, "image_id").where(inside).select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


#: The colour of each site of the 2 x 2 cell, row by row.
CFA = {"rggb": "rggb", "bggr": "bggr", "grbg": "grbg", "gbrg": "gbrg"}


def cfa_subset(px: DataFrame, cfa: str, colour: str) -> DataFrame:
    """P10: the sites of one colour of the pattern."""
    sites = [i for i, c in enumerate(CFA[cfa]) if c == colour]
    return px.where(((F.col("y") % 2) * 2 + F.col("x") % 2).isin(sites))


def roi_contains(px: DataFrame, rois: DataFrame, half_width: float, bucket: int = 16) -> DataFrame:
    """Pixels along and across each segment (ax, ay)-(bx, by): 0 <= along <= length, |across| <= half_width.

    A range join by buckets: both sides are filed by tiles of bucket pixels, so only pixels near a segment's box are compared.
    """
    tile = lambda c: F.floor(c / bucket).cast("int")
    lo = lambda a, b: tile(F.least(a, b) - half_width)
    hi = lambda a, b: tile(F.greatest(a, b) + half_width)
    r = rois.withColumn("ty", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by")))).withColumn("tx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx"))))
    p = px.withColumn("ty", tile(F.col("y"))).withColumn("tx", tile(F.col("x")))
    w, h, dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    length = F.sqrt(w**2 + h**2)
    along, across = dx * w / length + dy * h / length, dy * w / length - dx * h / length  # divided last: a pixel right on the limit is inside
    j = p.join(r, ["image_id", "ty", "tx"]).withColumn("along", along).withColumn("across", across)
    return j.where(F.col("along").between(0, length) & (F.abs("across") <= half_width)).select("image_id", "roi_id", "y", "x", "v", "along", "across")


def roi_bounds(rois: DataFrame, images: DataFrame, half_width: float) -> DataFrame:
    """Each segment's box of whole pixels, clamped to the image."""
    low = lambda a, b: F.greatest(F.lit(0), F.rint(F.least(a, b) - half_width).cast("int"))
    high = lambda a, b, n: F.least(F.col(n) - 1, F.rint(F.greatest(a, b) + half_width).cast("int"))
    return rois.join(images, "image_id").select("image_id", "roi_id", low("ax", "bx").alias("x0"), high("ax", "bx", "width").alias("x1"), low("ay", "by").alias("y0"), high("ay", "by", "height").alias("y1"))


def zap_borders(mask: DataFrame, images: DataFrame, n: int = 2) -> DataFrame:
    """The n outermost rows and columns leave the mask."""
    return mask.join(images, "image_id").where(F.col("y").between(n, F.col("height") - 1 - n) & F.col("x").between(n, F.col("width") - 1 - n)).select(*mask.columns)


def inside_quad(px: DataFrame, quads: DataFrame) -> DataFrame:
    """Pixels on the positive side of the four normals (nx_k, ny_k through cx_k, cy_k) of each quad, tested inside its box (x0, x1, y0, y1)."""
    box = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    sides = [(F.col("x") - F.col(f"cx_{k}")) * F.col(f"nx_{k}") + (F.col("y") - F.col(f"cy_{k}")) * F.col(f"ny_{k}") >= 0 for k in range(4)]
    return px.join(quads, "image_id").where(box & sides[0] & sides[1] & sides[2] & sides[3]).select("image_id", "block_id", "y", "x", "v")


# Histograms


def intensity_histogram(px: DataFrame, shift: int = 0) -> DataFrame:
    """H1: pixels by value, the value shifted right."""
    return px.groupBy("image_id", F.shiftright("v", shift).alias("v")).agg(F.count("*").alias("n"))


def cumulative_histogram(h: DataFrame) -> DataFrame:
    """H2: running counts from below and from above. A histogram has at most 65536 rows an image."""
    w = W.partitionBy("image_id").orderBy("v")
    return h.select("image_id", "v", "n", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("below"), F.sum("n").over(w.rowsBetween(0, W.unboundedFollowing)).alias("above"))


def otsu(h: DataFrame) -> DataFrame:
    """H3: the threshold with the largest variance between classes; the mean of the first and the last of equals."""
    w, whole = W.partitionBy("image_id").orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("image_id")
    t = h.select("image_id", "v", F.sum("n").over(w).cast("double").alias("wb"), F.sum(F.col("n") * F.col("v")).over(w).cast("double").alias("sb"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    t = t.withColumn("c", F.when(wf > 0, F.col("wb") * wf * gap * gap)).withColumn("best", F.max("c").over(whole))
    return t.where("c = best").groupBy("image_id").agg(((F.min("v") + F.max("v")) / 2).alias("threshold"))


def axis_projections(px: DataFrame, step: int = 2) -> DataFrame:
    """H4: sums of v / 65536 by row and by column on the even grid, from one pass; each odd slot copies the even one before it."""
    even = px.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    sums = even.groupingSets([["image_id", "y"], ["image_id", "x"]], "image_id", "y", "x").agg(F.sum(F.col("v") / 65536.0).alias("s"), F.grouping("x").alias("gx"))
    axis = F.when(F.col("gx") == 1, "row").otherwise("column")
    at = F.when(F.col("gx") == 1, F.col("y")).otherwise(F.col("x"))
    return sums.select("image_id", axis.alias("axis"), F.explode(F.array(at, at + 1)).alias("at"), "s")


def exposure_checks(h: DataFrame, top: int = 65535) -> DataFrame:
    """H9: per cent of highlights clipped (a spike of over 5 % in the last 5 % of the range), of shadows, and of over-exposed pixels."""
    total = h.groupBy("image_id").agg(F.sum("n").alias("total"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    j = h.join(total, "image_id")
    span = F.col("hi") - F.col("lo")
    high = F.max(F.when(F.col("v") >= F.col("hi") - 0.05 * span, F.col("n"))) / F.first("total") * 100
    low = F.max(F.when(F.col("v") <= F.col("lo") + 0.05 * span, F.col("n"))) / F.first("total") * 100
    over = F.sum(F.when(F.col("v") >= 0.95 * top, F.col("n")).otherwise(0)) / F.first("total") * 100
    return j.groupBy("image_id").agg(F.when(high > 5, high).otherwise(0.0).alias("highlight_pct"), F.when(low > 5, low).otherwise(0.0).alias("shadow_pct"), over.alias("over_pct"))


def match_histogram(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Each value of src (v, below) with the value of dst whose running count is nearest; the smaller of two as near."""
    a = src.select("image_id", F.col("below").cast("double").alias("c"), F.col("v").alias("v"), F.lit(None).cast("int").alias("to"))
    b = dst.select("image_id", F.col("below").cast("double").alias("c"), F.lit(None).cast("int").alias("v"), F.col("v").alias("to"))
    w = W.partitionBy("image_id").orderBy("c", F.col("to").isNull().cast("int"))
    held = F.when(F.col("to").isNotNull(), F.struct("c", "to"))
    both = a.unionByName(b).withColumn("p", F.last(held, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("q", F.first(held, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    near = F.when(F.col("q").isNull() | (F.col("c") - F.col("p.c") <= F.col("q.c") - F.col("c")), F.col("p.to")).otherwise(F.col("q.to"))
    return both.where("v is not null").select("image_id", "v", F.coalesce(near, F.col("q.to")).alias("to"))


def roi_side_histograms(px: DataFrame, rois: DataFrame, dead: float = 4, half_width: float = 28) -> DataFrame:
    """256-bin histograms of the two sides of each segment beyond a dead zone; the darker side by mean is called dark."""
    j = roi_contains(px, rois, half_width).where(F.abs("across") > dead)
    h = j.groupBy("image_id", "roi_id", (F.col("across") > 0).alias("right"), F.shiftright("v", 8).alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    w = W.partitionBy("image_id", "roi_id")
    mean = lambda c: F.sum(F.when(c, F.col("s"))).over(w) / F.sum(F.when(c, F.col("n"))).over(w)
    darker_right = F.coalesce(mean(F.col("right")) < mean(~F.col("right")), F.lit(False))
    return h.select("image_id", "roi_id", F.when(F.col("right") == darker_right, "dark").otherwise("light").alias("side"), "bin", "n")


# Neighbourhoods


def box_sums(px: DataFrame, size: int) -> DataFrame:
    """Sums of v and v^2 over a size x size box around each pixel, as rows first, then columns; index 0 never counts.

    For a dense picture the frames are ranges of coordinates. The image and row are the window's keys, so a partition holds a row or a column.
    """
    lo, hi = -(size // 2) + 1, size // 2
    by_row = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(lo, hi)
    by_col = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(lo, hi)
    v = F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("v")).otherwise(0).cast("long")
    rows = px.select("image_id", "y", "x", "v", F.sum(v).over(by_row).alias("r"), F.sum(v * v).over(by_row).alias("r2"))
    return rows.select("image_id", "y", "x", "v", F.sum("r").over(by_col).alias("s"), F.sum("r2").over(by_col).alias("s2"))


def _count(images: DataFrame, boxes: DataFrame, size: int) -> tuple[DataFrame, Column]:
    half = size // 2
    side = lambda at, n: F.least(F.col(at) + half, F.col(n) - 1) - F.greatest(F.col(at) - half, F.lit(0))
    return boxes.join(images, "image_id"), side("x", "width") * side("y", "height")


def sauvola_mask(px: DataFrame, images: DataFrame, t: float, size: int) -> DataFrame:
    """Object pixels: v < mean * (1 + t * (sd * 2 / max - 1)). images: image_id, width, height, top."""
    boxes, n = _count(images, box_sums(px, size), size)
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean))
    return boxes.where(F.col("v") < mean * (1 + t * (sd * 2 / F.col("top") - 1))).select("image_id", "y", "x")


def bradley_mask(px: DataFrame, images: DataFrame, t: float, size: int) -> DataFrame:
    """Object pixels: v * count < sum * (1 - t)."""
    boxes, n = _count(images, box_sums(px, size), size)
    return boxes.where(F.col("v") * n < F.col("s") * (1 - t)).select("image_id", "y", "x")


def gaussian_blur5(px: DataFrame, sigma: float = 1.2) -> DataFrame:
    """A 5 x 5 Gaussian as two passes of five taps, scaled by the image's maximum; at the border neighbours are reflected."""
    raw = [2.718281828459045 ** (-(d * d) / (2 * sigma * sigma)) for d in range(-2, 3)]
    taps = [r / sum(raw) for r in raw]

    def blur(df: DataFrame, other: str, along: str) -> DataFrame:
        w = W.partitionBy("image_id", other).orderBy(along)
        at = lambda d: F.lag("g", -d).over(w) if d < 0 else (F.col("g") if d == 0 else F.lead("g", d).over(w))
        total = sum((taps[d + 2] * F.coalesce(at(d), at(-d), F.col("g")) for d in range(-2, 3)), F.lit(0.0))
        return df.withColumn("b", total).drop("g").withColumnRenamed("b", "g")

    top = px.groupBy("image_id").agg(F.max("v").alias("top"))
    scaled = px.join(top, "image_id").select("image_id", "y", "x", (F.col("v") / F.col("top")).alias("g"))
    return blur(blur(scaled, "y", "x"), "x", "y")


def gradients(px: DataFrame, value: str = "v") -> DataFrame:
    """Central differences, zero at the borders, and g2 = gx^2 + gy^2 (no root)."""
    wx, wy = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    d = lambda w: F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2.0, F.lit(0.0))
    g = px.select("image_id", "y", "x", d(wx).alias("gx"), d(wy).alias("gy"))
    return g.withColumn("g2", F.col("gx") ** 2 + F.col("gy") ** 2)


def _offsets(r: int) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r + 0.5 or r == 1])


def mean_gradient_dir(g: DataFrame, points: DataFrame) -> DataFrame:
    """The mean gradient of the 3 x 3 neighbours of each point, weighted by g2, turned by 90 degrees."""
    near = points.withColumn("o", F.explode(_offsets(1))).select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    s = near.join(g, ["image_id", "y", "x"]).groupBy("image_id", "py", "px").agg(*[(F.sum(F.col(c) * F.col("g2")) / F.nullif(F.sum("g2"), F.lit(0.0))).alias(c) for c in ("gx", "gy")])
    return s.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), (-F.col("gy")).alias("dx"), F.col("gx").alias("dy"))


def _spread(mask: DataFrame, r: int) -> DataFrame:
    return mask.withColumn("o", F.explode(_offsets(r))).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))


def dilate(mask: DataFrame, r: int) -> DataFrame:
    """Pixels with an object pixel in the element around them."""
    return _spread(mask, r).distinct()


def erode(mask: DataFrame, r: int) -> DataFrame:
    """Pixels whose whole element is in the mask."""
    n = sum(1 for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r + 0.5 or r == 1)
    return _spread(mask, r).groupBy("image_id", "y", "x").agg(F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def opened(mask: DataFrame, r: int = 1) -> DataFrame:
    """Erosion, then dilation."""
    return dilate(erode(mask, r), r)


def partial_target_gradient(g: DataFrame, comps: DataFrame, images: DataFrame, fill: float) -> DataFrame:
    """In the rows and columns 2 and n - 3, the gradient of pixels of an object that touches the frame is overwritten."""
    on_edge = (F.col("y") == 2) | (F.col("x") == 2) | (F.col("y") == F.col("height") - 3) | (F.col("x") == F.col("width") - 3)
    marked = comps.join(images, "image_id").where(on_edge).select("image_id", "y", "x").distinct().withColumn("hit", F.lit(True))
    j = g.join(marked, ["image_id", "y", "x"], "left")
    return j.select("image_id", "y", "x", "gx", "gy", F.when(F.col("hit"), F.lit(fill)).otherwise(F.col("g2")).alias("g2"))


def demosaic_green(px: DataFrame, cfa: str = "rggb", mixed: float = 0.5) -> DataFrame:
    """Green at the other sites, along the direction of the smaller gradient; the mean of four where the two are about equal; existing neighbours at borders."""
    wx, wy = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    l, r, u, d = F.lag("v").over(wx), F.lead("v").over(wx), F.lag("v").over(wy), F.lead("v").over(wy)
    t = px.select("image_id", "y", "x", "v", l.alias("l"), r.alias("r"), u.alias("u"), d.alias("d"))
    two = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2.0
    h, v = two("l", "r"), two("u", "d")
    gh, gv = F.abs(F.coalesce(F.col("l") - F.col("r"), F.lit(0))), F.abs(F.coalesce(F.col("u") - F.col("d"), F.lit(0)))
    even = F.abs(gh - gv) <= mixed * 0.001 * (gh + gv + 1)
    green = F.when(even | h.isNull() | v.isNull(), (F.coalesce(h, v) + F.coalesce(v, h)) / 2).when(gh < gv, h).otherwise(v)
    sites = [i for i, c in enumerate(CFA[cfa]) if c == "g"]
    own = ((F.col("y") % 2) * 2 + F.col("x") % 2).isin(sites)
    return t.select("image_id", "y", "x", F.when(own, F.col("v")).otherwise(F.coalesce(green, F.col("v"))).cast("int").alias("v"))


def stretch_blend(px: DataFrame, stretch: Column, lo: float = 0.4, hi: float = 0.9) -> DataFrame:
    """Raw and 3 x 3 mean, mixed by the local stretch, the share of the mean between lo and hi."""
    near = px.withColumn("o", F.explode(_offsets(1))).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v")
    mean = near.groupBy("image_id", "y", "x").agg(F.avg("v").alias("mean"))
    share = F.least(F.lit(hi), F.greatest(F.lit(lo), stretch))
    return px.join(mean, ["image_id", "y", "x"]).select("image_id", "y", "x", (share * F.col("mean") + (1 - share) * F.col("v")).alias("v"))


def autocrop_bounds(proj: DataFrame, border: int = 150) -> DataFrame:
    """H5: for each axis of a projection (image_id, axis, at, s): the first and the last place brighter than Otsu's threshold on rint(20 s), widened by border, cut to the picture and made even."""
    h = proj.select(F.struct("image_id", "axis").alias("image_id"), F.rint(F.col("s") * 20).cast("int").alias("v")).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    t = otsu(h).select("image_id.*", "threshold")
    j = proj.join(t, ["image_id", "axis"])
    lit = F.rint(F.col("s") * 20) > F.col("threshold")
    b = j.groupBy("image_id", "axis").agg(F.min(F.when(lit, F.col("at"))).alias("a"), F.max(F.when(lit, F.col("at"))).alias("z"), F.max("at").alias("end"))
    lo, hi = F.greatest(F.lit(0), F.col("a") - border), F.least(F.col("end"), F.col("z") + border)
    return b.select("image_id", "axis", (lo - lo % 2).alias("lo"), (hi - hi % 2).alias("hi"))


def autocrop_margins(proj: DataFrame, border: int = 150) -> DataFrame:
    """H5 in full: image_id, axis, lo, hi: as autocrop_bounds, with a second threshold where a margin is bright.

    A margin is a run of places not darker than Otsu's threshold that begins within a tenth of the axis from its end, up to a quarter of the axis. Where an
    axis has one, values above the threshold are replaced by the median and the threshold is taken anew. The last bright place is sought from the left margin's
    end on, the first one before the right margin's start; a place that is bright by the new threshold counts, in the other margin too.
    """
    level = F.rint(F.col("s") * 20).cast("int")
    axis = ["image_id", "axis"]

    def threshold(rows: DataFrame, name: str) -> DataFrame:
        h = rows.select(F.struct(*axis).alias("image_id"), F.col("v")).groupBy("image_id", "v").agg(F.count("*").alias("n"))
        return otsu(h).select("image_id.*", F.col("threshold").alias(name))

    p = proj.select(*axis, "at", level.alias("v"))
    p = p.join(threshold(p, "t"), axis).withColumn("n", F.count("*").over(W.partitionBy(*axis)))
    quarter, three = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4)
    bright, dim = F.col("v") >= F.col("t"), F.col("v") <= F.col("t")
    first = p.groupBy(*axis, "n", "t").agg(F.min(F.when(bright, F.col("at"))).alias("l1"), F.max(F.when(bright, F.col("at"))).alias("r1"))
    first = first.withColumns({"l1": F.least(F.coalesce("l1", quarter), quarter), "r1": F.greatest(F.coalesce("r1", three), three)})
    ends = p.join(first.select(*axis, "l1", "r1"), axis).groupBy(*axis, "n", "t", "l1", "r1").agg(F.min(F.when(dim & (F.col("at") >= F.col("l1")), F.col("at"))).alias("l2"), F.max(F.when(dim & (F.col("at") <= F.col("r1")), F.col("at"))).alias("r2"))
    left = F.when(F.col("l1") < 0.1 * F.col("n"), F.least(F.coalesce("l2", quarter), quarter)).otherwise(0)
    right = F.when(F.col("r1") > 0.9 * F.col("n"), F.greatest(F.coalesce("r2", three), three)).otherwise(F.col("n") - 1)
    ends = ends.select(*axis, "n", left.alias("left"), right.alias("right"))
    ends = ends.withColumn("skips", (F.col("left") > 0) | (F.col("right") < F.col("n") - 1)).drop("n")
    p = p.join(ends, axis).withColumn("_i", F.row_number().over(W.partitionBy(*axis).orderBy("v", "at")) - 1)
    middle = F.max(F.when(F.col("_i") == F.floor(F.col("n") / 2), F.col("v"))).over(W.partitionBy(*axis))
    p = p.withColumn("calm", F.when(F.col("skips") & (F.col("v") > F.col("t")), middle).otherwise(F.col("v")))
    p = p.join(threshold(p.select(*axis, F.col("calm").alias("v")), "t2"), axis, "left").withColumn("t2", F.when(F.col("skips"), F.coalesce("t2", "t")).otherwise(F.col("t")))
    lit = F.col("v") > F.col("t2")
    b = p.groupBy(*axis, "left", "right", "n").agg(F.max(F.when(lit & (F.col("at") >= F.col("left")), F.col("at"))).alias("z"), F.min(F.when(lit & (F.col("at") <= F.col("right")) & (F.col("at") > 0), F.col("at"))).alias("a"))
    lo, hi = F.coalesce("a", "right") - border, F.least(F.col("n") - 1, F.coalesce("z", "left") + border)
    return b.select(*axis, F.greatest(F.lit(0), lo + lo % 2).cast("int").alias("lo"), (hi - hi % 2).cast("int").alias("hi"))


def bar_bounds(px: DataFrame, images: DataFrame, threshold: float, share: float = 0.035) -> DataFrame:
    """H6: in each column, the first dark run from the top that is shorter than a share of the height; columns without one are left out."""
    dark = px.where(F.col("v") < threshold).select("image_id", "y", "x")
    island = F.col("y") - F.row_number().over(W.partitionBy("image_id", "x").orderBy("y"))
    r = dark.withColumn("i", island).groupBy("image_id", "x", "i").agg(F.min("y").alias("y0"), F.count("*").alias("n"))
    r = r.join(images, "image_id").where(F.col("n") < share * F.col("height"))
    return r.groupBy("image_id", "x").agg(F.min(F.struct("y0", "n")).alias("s")).select("image_id", "x", F.col("s.y0").alias("y"), F.col("s.n").alias("n"))


def bar_points(px: DataFrame, images: DataFrame, threshold: float | str, share: float = 0.035) -> DataFrame:
    """H6, points: image_id, side (top, bottom), x, y: in each column, where the first dark run from that side ends, if it begins within a fifth of the height and is
    shorter than a share of it. threshold: a number, or a column of images."""
    dark = F.col("v") <= (F.col(threshold) if isinstance(threshold, str) else F.lit(threshold))
    p = px.join(images, "image_id")
    reach, most = F.floor(F.col("height") / 5), F.floor(share * F.col("height"))
    island = F.col("y") - F.row_number().over(W.partitionBy("image_id", "x").orderBy("y"))
    runs = p.where(dark).withColumn("_i", island).groupBy("image_id", "x", "height", "_i").agg(F.min("y").alias("a"), F.max("y").alias("z"))
    ends = runs.groupBy("image_id", "x", "height").agg(F.min(F.struct("a", "z")).alias("t"), F.max(F.struct("z", "a")).alias("b"))
    long = F.col("z") - F.col("a") + 1
    top = ends.select("image_id", "x", "height", "t.a", "t.z").where((F.col("a") < reach) & (long < most) & (F.col("z") < F.col("height") - 1)).select("image_id", F.lit("top").alias("side"), "x", (F.col("z") + 1).alias("y"))
    bottom = ends.select("image_id", "x", "height", "b.a", "b.z").where((F.col("z") > F.col("height") - 1 - reach) & (long < most) & (F.col("a") > 0)).select("image_id", F.lit("bottom").alias("side"), "x", (F.col("a") - 1).alias("y"))
    return top.unionByName(bottom)


def bar_crop(px: DataFrame, images: DataFrame, lines, threshold: float | str, share: float = 0.035) -> DataFrame:
    """H6 in full: image_id, y0, y1, fill for every picture: the rows between the bars at top and bottom, and the value to fill them with.

    lines: a robust line through points x, y by keys (H7). Bars count if each side has ten points that span the columns from 30 to 70 %, and both lines
    are found; the crop then begins below the lower end of the top line and ends above the higher end of the bottom one. Else it is the
    whole picture. fill: the brightness that a quarter of the pixels exceed, in steps of 8.
    """
    keys = ["image_id", "side"]
    pts = bar_points(px, images, threshold, share)
    sound = pts.join(images, "image_id").groupBy(*keys, "width").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    sound = sound.where((F.col("n") >= 10) & (F.col("x0") <= 0.3 * F.col("width")) & (F.col("x1") >= 0.7 * F.col("width")))
    at = lines(pts.join(sound.select(*keys), keys, "left_semi"), keys).join(sound, keys)
    e0, e1 = F.col("slope") * F.col("x0") + F.col("offset"), F.col("slope") * F.col("x1") + F.col("offset")
    both = at.groupBy("image_id").agg(F.count("*").alias("sides"), F.max(F.when(F.col("side") == "top", F.greatest(e0, e1) + 1)).alias("top"), F.max(F.when(F.col("side") == "bottom", F.least(e0, e1) - 1)).alias("bottom")).where("sides = 2")
    h = cumulative_histogram(intensity_histogram(px.withColumn("v", F.col("v").cast("int")), 3)).join(px.groupBy("image_id").agg(F.count("*").alias("total")), "image_id")
    fill = h.groupBy("image_id").agg(((F.min(F.when(F.col("below") > 0.75 * F.col("total"), F.col("v"))) - 1) * 8).alias("fill"))
    j = images.join(both, "image_id", "left").join(fill, "image_id")
    whole = F.col("sides").isNull()
    return j.select("image_id", F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.rint("top"))).cast("int").alias("y0"), F.when(whole, F.col("height") - 1).otherwise(F.greatest(F.lit(0), F.rint("top")) + F.rint(F.col("bottom") - F.col("top")) - 1).cast("int").alias("y1"), "fill")


def demosaic_red_blue(px: DataFrame, cfa: str = "rggb", colour: str = "r") -> DataFrame:
    """One colour at all sites, in two passes over windows: first at the opposite colour's sites from the weaker of the two diagonal gradients
    (the mean of four where they are about equal), then at the green sites from the weaker of the horizontal and vertical ones. Means are cut to whole numbers.
    """
    pos = CFA[cfa].index(colour)
    opposite = 3 - pos
    site = (F.col("y") % 2) * 2 + F.col("x") % 2
    start = px.select("image_id", "y", "x", F.when(site == pos, F.col("v")).alias("c"))

    def fill(df, first, second, where):
        w1, w2 = first, second
        a, b, c, d = F.lag("c").over(w1), F.lead("c").over(w1), F.lag("c").over(w2), F.lead("c").over(w2)
        t = df.select("image_id", "y", "x", "c", a.alias("a"), b.alias("b"), c.alias("d"), d.alias("e"))
        two = lambda p, q: (F.coalesce(p, q) + F.coalesce(q, p)) / 2
        g1, g2 = F.abs(F.coalesce(F.col("a") - F.col("b"), F.lit(0))), F.abs(F.coalesce(F.col("d") - F.col("e"), F.lit(0)))
        m1, m2 = two("a", "b"), two("d", "e")
        even = F.abs(g1 - g2) <= 0.001 * (g1 + g2 + 1)
        v = F.when(even | m1.isNull() | m2.isNull(), (F.coalesce(m1, m2) + F.coalesce(m2, m1)) / 2).when(g1 < g2, m1).otherwise(m2)
        return t.select("image_id", "y", "x", F.when(where & F.col("c").isNull(), v.cast("int")).otherwise(F.col("c")).alias("c"))

    down = W.partitionBy("image_id", F.col("x") - F.col("y")).orderBy("y")
    up = W.partitionBy("image_id", F.col("x") + F.col("y")).orderBy("y")
    one = fill(start, down, up, site == opposite)
    across, along = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    two = fill(one, across, along, (site != pos) & (site != opposite))
    return two.select("image_id", "y", "x", F.col("c").alias("v"))
