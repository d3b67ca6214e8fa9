"""Queries of the pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acutance.operators import raster
from acutance.plans.curves import rounded
from acutance.plans.registry import register, view


def px(spark, d):
    return view(spark, d, "v_pixels")


def images(spark, d):
    p = px(spark, d)
    return p.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.max("v").alias("top"))


def rgb(spark, d):
    """Each four rasters in a row as channels of one picture."""
    return px(spark, d).select(F.floor(F.col("image_id") / 4).cast("int").alias("image_id"), (F.col("image_id") % 4).alias("channel"), "y", "x", "v")


def mask(spark, d):
    return px(spark, d).where("v < 30000").select("image_id", "y", "x")


def rois(spark, d):
    e = view(spark, d, "v_edges")
    return e.select("image_id", F.col("edge_id").alias("roi_id"), (F.col("ex") % 32).alias("ax"), (F.col("ey") % 48).alias("ay"), ((F.col("ex") + F.col("edge_id")) % 32 + 1.5).alias("bx"), (F.col("ey") % 37).alias("by"))


IMAGES = "im as (select image_id, max(x) + 1 width, max(y) + 1 height, max(v) top from v_pixels group by 1)"
ROIS = "rois as (select image_id, edge_id roi_id, ex % 32 ax, ey % 48 ay, (ex + edge_id) % 32 + 1.5e0 bx, ey % 37 as by_ from v_edges)"
MASK = "mask as (select image_id, y, x from v_pixels where v < 30000)"
LIN = "cast(round_even(greatest(0, least(1, case when v/65535.0e0 < 0.04045 then v/65535.0e0/12.92 else pow((v/65535.0e0 + 0.055e0)/1.055e0, 2.4e0) end))*65535, 0) as int)"


@register("p1_linearise", "select image_id, y, x, cast(round_even(greatest(0, least(1, case when v/65535.0e0 < 0.1 then 0.5e0*(v/65535.0e0) + 0.01e0 else pow(v/65535.0e0*0.9e0 + 0.1e0, 1.8e0) end))*65535, 0) as int) v from v_pixels")
def _p1(spark, d):
    return raster.linearise(px(spark, d), (1.8, 0.9, 0.1, 0.5, 0.1, 0.0, 0.01))


@register("p2_linearise_srgb", f"select image_id, y, x, {LIN} v from v_pixels")
def _p2(spark, d):
    return raster.linearise(px(spark, d))


@register("p3_linearise_table", """with kn as (select cast(r_regionkey*12000 + 8000 as int) x, cast(r_regionkey*r_regionkey*3000 + 100 as int) y from region),
s as (select x x0, y y0, lead(x) over (order by x) x1, lead(y) over (order by x) y1, row_number() over (order by x) n from kn)
select p.image_id, p.y, p.x, cast(round_even(case when (n = 1 and v < x0) or x1 is null then y0 else y0 + (v - x0)*cast(y1 - y0 as double)/(x1 - x0) end, 0) as int) v
from v_pixels p join s on (n = 1 and v < x0) or (v >= x0 and (x1 is null or v < x1))""")
def _p3(spark, d):
    from acutance.session import read_table

    r = read_table(spark, d, "region")
    knots = r.select((F.col("r_regionkey") * 12000 + 8000).cast("int").alias("x"), (F.col("r_regionkey") * F.col("r_regionkey") * 3000 + 100).cast("int").alias("y"))
    return raster.linearise_table(px(spark, d), knots)


@register("p4_widen_8bit", "select image_id, y, x, (v >> 8) << 8 as v from v_pixels")
def _p4(spark, d):
    return raster.widen_8bit(px(spark, d).withColumn("v", F.shiftright("v", 8)))


@register("p5_luminance", "select image_id // 4 image_id, y, x, cast(trunc(sum(v*case image_id % 4 when 0 then 0.2126e0 when 1 then 0.7152e0 else 0.0722e0 end) + 0.5e0) as int) v from v_pixels where image_id % 4 < 3 group by image_id // 4, y, x")
def _p5(spark, d):
    return raster.luminance(rgb(spark, d))


@register("p6_linear_rgb", f"select image_id // 4 image_id, image_id % 4 channel, y, x, {LIN} v from v_pixels where image_id % 4 < 3")
def _p6(spark, d):
    return raster.linear_rgb(rgb(spark, d))


@register("p7_pad_border", f"""with {IMAGES}, f as (select image_id, cast(y as int) y, cast(x as int) x, top v from im, (select unnest(range(0, 200)) y), (select unnest(range(0, 200)) x)
  where y < height + 10 and x < width + 10 and not (y between 5 and height + 4 and x between 5 and width + 4))
select * from f union all select image_id, y + 5, x + 5, v from v_pixels""")
def _p7(spark, d):
    return raster.pad_border(px(spark, d), images(spark, d).select("image_id", "width", "height"), 5)


@register("p8_invert", f"with {IMAGES} select p.image_id, y, x, cast(greatest(0, pow(2, greatest(1, ceil(log2(top)))) - 1 - v) as int) v from v_pixels p join im using (image_id)")
def _p8(spark, d):
    return raster.invert(px(spark, d))


@register("p9_crop", "select image_id, y - (4 + image_id) y, x - 3 as x, v from v_pixels where y between 4 + image_id and 40 and x between 3 and 28 - image_id")
def _p9(spark, d):
    b = images(spark, d).select("image_id", (F.col("image_id") + 4).alias("y0"), F.lit(40).alias("y1"), F.lit(3).alias("x0"), (F.lit(28) - F.col("image_id")).alias("x1"))
    return raster.crop(px(spark, d), b)


@register("p10_cfa_subset", "select * from v_pixels where (y % 2)*2 + x % 2 in (1, 2)")
def _p10(spark, d):
    return raster.cfa_subset(px(spark, d), "rggb", "g")


_ROI = f"""with {ROIS}, l as (select *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) len from rois),
j as (select p.image_id, roi_id, y, x, v, len, (x - ax)*(bx - ax)/len + (y - ay)*(by_ - ay)/len along, (y - ay)*(bx - ax)/len - (x - ax)*(by_ - ay)/len across from v_pixels p join l using (image_id))"""


@register("p11_roi_contains", _ROI + " select image_id, roi_id, y, x, v, round(along, 6) + 0.0e0 along, round(across, 6) + 0.0e0 across from j where along between 0 and len and abs(across) <= 6")
def _p11(spark, d):
    return rounded(raster.roi_contains(px(spark, d), rois(spark, d), 6.0), "along", "across")


@register("p12_roi_bounds", f"""with {IMAGES}, {ROIS} select image_id, roi_id, greatest(0, cast(round_even(least(ax, bx) - 6, 0) as int)) x0, least(width - 1, cast(round_even(greatest(ax, bx) + 6, 0) as int)) x1,
  greatest(0, cast(round_even(least(ay, by_) - 6, 0) as int)) y0, least(height - 1, cast(round_even(greatest(ay, by_) + 6, 0) as int)) y1 from rois join im using (image_id)""")
def _p12(spark, d):
    return raster.roi_bounds(rois(spark, d), images(spark, d), 6.0)


@register("p13_zap_borders", f"with {IMAGES}, {MASK} select image_id, y, x from mask join im using (image_id) where y between 2 and height - 3 and x between 2 and width - 3")
def _p13(spark, d):
    return raster.zap_borders(mask(spark, d), images(spark, d))


@register("p14_inside_quad", """with q as (select edge_id b, image_id, ex % 32 cx, ey % 48 cy, 2 + edge_id % 5 h from v_edges)
select p.image_id, b block_id, y, x, v from v_pixels p join q using (image_id) where x between cx - 2*h and cx + 2*h and y between cy - 2*h and cy + 2*h
  and (x - cx + h)*0.8e0 + (y - cy)*0.6e0 >= 0 and -(x - cx - h)*0.8e0 - (y - cy)*0.6e0 >= 0 and -(x - cx)*0.6e0 + (y - cy + h)*0.8e0 >= 0 and (x - cx)*0.6e0 - (y - cy - h)*0.8e0 >= 0""")
def _p14(spark, d):
    h, cx, cy = 2 + F.col("edge_id") % 5, F.col("ex") % 32, F.col("ey") % 48
    sides = [(cx - h, cy, 0.8, 0.6), (cx + h, cy, -0.8, -0.6), (cx, cy - h, -0.6, 0.8), (cx, cy + h, 0.6, -0.8)]
    cols = {f"{n}_{k}": c for k, s in enumerate(sides) for n, c in zip(("cx", "cy", "nx", "ny"), (s[0], s[1], F.lit(s[2]), F.lit(s[3])))}
    q = view(spark, d, "v_edges").withColumns(cols | {"x0": cx - 2 * h, "x1": cx + 2 * h, "y0": cy - 2 * h, "y1": cy + 2 * h, "block_id": F.col("edge_id")})
    return raster.inside_quad(px(spark, d), q.drop("edge_id", "ex", "ey", "angle", "mtf", "quality"))


H = "h as (select image_id, v >> 6 v, count(*) n from v_pixels group by 1, 2)"


def hist(spark, d):
    return raster.intensity_histogram(px(spark, d), 6)


@register("h1_intensity_histogram", f"with {H} select * from h")
def _h1(spark, d):
    return hist(spark, d)


@register("h2_cumulative_histogram", f"with {H} select image_id, v, n, cast(sum(n) over (partition by image_id order by v) as bigint) below, cast(sum(n) over (partition by image_id order by v desc) as bigint) above from h")
def _h2(spark, d):
    return raster.cumulative_histogram(hist(spark, d))


@register("h3_otsu", f"""with {H}, t as (select image_id, v, cast(sum(n) over w as double) wb, cast(sum(n*v) over w as double) sb, sum(n) over (partition by image_id) wt, sum(n*v) over (partition by image_id) st from h window w as (partition by image_id order by v)),
c as (select *, case when wt > wb then wb*(wt - wb)*(sb/wb - (st - sb)/(wt - wb))*(sb/wb - (st - sb)/(wt - wb)) end c from t), b as (select *, max(c) over (partition by image_id) best from c)
select image_id, (min(v) + max(v))/2.0e0 threshold from b where c = best group by 1""")
def _h3(spark, d):
    return raster.otsu(hist(spark, d))


@register("h4_axis_projections", """with e as (select * from v_pixels where y % 2 = 0 and x % 2 = 0),
s as (select image_id, 'row' axis, y as pos, sum(v/65536.0e0) s from e group by 1, 3 union all select image_id, 'column', x, sum(v/65536.0e0) from e group by 1, 3)
select image_id, axis, cast(pos + o as int) as at, round(s, 6) s from s, (select unnest([0, 1]) o)""")
def _h4(spark, d):
    return rounded(raster.axis_projections(px(spark, d)), "s")


@register("h9_exposure_checks", """with g as (select image_id, v >> 10 v, count(*) n from v_pixels group by 1, 2), t as (select image_id, sum(n) total, max(v) hi, min(v) lo from g group by 1),
x as (select image_id, coalesce(max(case when v >= hi - 0.05e0*(hi - lo) then n end)*100.0e0/max(total), 0) h, coalesce(max(case when v <= lo + 0.05e0*(hi - lo) then n end)*100.0e0/max(total), 0) l,
  sum(case when v >= 0.95e0*50 then n else 0 end)*100.0e0/max(total) o from g join t using (image_id) group by 1)
select image_id, round(case when h > 5 then h else 0 end, 6) highlight_pct, round(case when l > 5 then l else 0 end, 6) shadow_pct, round(o, 6) over_pct from x""")
def _h9(spark, d):
    return rounded(raster.exposure_checks(raster.intensity_histogram(px(spark, d), 10), 50), "highlight_pct", "shadow_pct", "over_pct")


@register("h10_match_histogram", f"""with {H}, c as (select image_id, v, sum(n) over (partition by image_id order by v) b from h),
s as (select image_id, v, b from c where image_id < 2), t as (select image_id - 2 image_id, v vt, b bt from c where image_id >= 2),
r as (select s.image_id, s.v, t.vt, row_number() over (partition by s.image_id, s.v order by abs(bt - b), bt) k from s join t using (image_id)) select image_id, v, vt as "to" from r where k = 1""")
def _h10(spark, d):
    c = raster.cumulative_histogram(hist(spark, d))
    return raster.match_histogram(c.where("image_id < 2"), c.where("image_id >= 2").withColumn("image_id", F.col("image_id") - 2))


@register("h11_roi_side_histograms", _ROI + """, k as (select * from j where along between 0 and len and abs(across) <= 9 and abs(across) > 2),
m as (select image_id, roi_id, avg(case when across > 0 then v end) r, avg(case when across <= 0 then v end) l from k group by 1, 2)
select image_id, roi_id, case when (across > 0) = coalesce(r < l, false) then 'dark' else 'light' end side, v >> 8 bin, count(*) n from k join m using (image_id, roi_id) group by 1, 2, 3, 4""")
def _h11(spark, d):
    return raster.roi_side_histograms(px(spark, d), rois(spark, d), 2, 9)


_BOX = f"""{IMAGES}, b as (select p.image_id, p.y, p.x, p.v, sum(case when q.x > 0 and q.y > 0 then cast(q.v as bigint) else 0 end) s, sum(case when q.x > 0 and q.y > 0 then cast(q.v as bigint)*q.v else 0 end) s2
  from v_pixels p join v_pixels q on p.image_id = q.image_id and q.x between p.x - 7 and p.x + 8 and q.y between p.y - 7 and p.y + 8 group by 1, 2, 3, 4),
bn as (select b.*, top, (least(x + 8, width - 1) - greatest(x - 8, 0))*(least(y + 8, height - 1) - greatest(y - 8, 0)) n from b join im using (image_id))"""


@register("n1_box_sums", f"with {_BOX} select image_id, y, x, v, cast(s as bigint) s, cast(s2 as bigint) s2 from b")
def _n1(spark, d):
    return raster.box_sums(px(spark, d), 16)


@register("n2_sauvola_mask", f"with {_BOX} select image_id, y, x from bn where v < s/cast(n as double)*(1 + 0.3e0*(sqrt(greatest(0, s2/cast(n as double) - (s/cast(n as double))*(s/cast(n as double))))*2/top - 1))")
def _n2(spark, d):
    return raster.sauvola_mask(px(spark, d), images(spark, d), 0.3, 16)


@register("n3_bradley_mask", f"with {_BOX} select image_id, y, x from bn where v*n < s*(1 - 0.05e0)")
def _n3(spark, d):
    return raster.bradley_mask(px(spark, d), images(spark, d), 0.05, 16)


def _sql_blur(src: str, other: str, along: str) -> str:
    import math

    raw = [math.exp(-(k * k) / 2.88) for k in range(-2, 3)]
    t = [r / sum(raw) for r in raw]
    at = lambda k: "g" if k == 0 else f"{'lag' if k < 0 else 'lead'}(g, {abs(k)}) over w"
    total = " + ".join(f"{t[k + 2]!r}::double*coalesce({at(k)}, {at(-k)}, g)" for k in range(-2, 3))
    return f"select image_id, y, x, {total} g from {src} window w as (partition by image_id, {other} order by {along})"


@register("n4_gaussian_blur5", f"with {IMAGES}, a as (select p.image_id, y, x, v/cast(top as double) g from v_pixels p join im using (image_id)), b as ({_sql_blur('a', 'y', 'x')}), c as ({_sql_blur('b', 'x', 'y')}) select image_id, y, x, round(g, 8) g from c")
def _n4(spark, d):
    return rounded(raster.gaussian_blur5(px(spark, d)), "g", digits=8)


_GRAD = """g as (select image_id, y, x, coalesce((lead(v) over wx - lag(v) over wx)/2.0e0, 0) gx, coalesce((lead(v) over wy - lag(v) over wy)/2.0e0, 0) gy from v_pixels
  window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)), gg as (select *, gx*gx + gy*gy g2 from g)"""


@register("n5_gradients", f"with {_GRAD} select image_id, y, x, gx, gy, g2 from gg")
def _n5(spark, d):
    return raster.gradients(px(spark, d))


@register("n6_mean_gradient_dir", f"with {_GRAD}, {MASK} select m.image_id, m.y, m.x, round(-sum(gy*g2)/nullif(sum(g2), 0), 4) + 0.0e0 dx, round(sum(gx*g2)/nullif(sum(g2), 0), 4) + 0.0e0 dy from mask m join gg g on m.image_id = g.image_id and abs(m.y - g.y) <= 1 and abs(m.x - g.x) <= 1 group by 1, 2, 3")
def _n6(spark, d):
    return rounded(raster.mean_gradient_dir(raster.gradients(px(spark, d)), mask(spark, d)), "dx", "dy", digits=4)


_EL = "o as (select a dy, b dx from (select unnest(range(-2, 3)) a), (select unnest(range(-2, 3)) b) where a*a + b*b <= 4.5)"


@register("n7_dilate", f"with {MASK}, {_EL} select distinct image_id, cast(y + dy as int) y, cast(x + dx as int) x from mask, o")
def _n7(spark, d):
    return raster.dilate(mask(spark, d), 2)


@register("n7_erode", f"with {MASK}, {_EL}, s as (select image_id, cast(y + dy as int) y, cast(x + dx as int) x from mask, o) select image_id, y, x from s group by 1, 2, 3 having count(*) = 13")
def _n7e(spark, d):
    return raster.erode(mask(spark, d), 2)


@register("n7_open", f"""with mk as (select image_id, y, x from v_pixels where v < 33000), o as (select a dy, b dx from (select unnest(range(-1, 2)) a), (select unnest(range(-1, 2)) b)),
e as (select image_id, cast(y + dy as int) y, cast(x + dx as int) x from mk, o), f as (select image_id, y, x from e group by 1, 2, 3 having count(*) = 9) select distinct image_id, cast(y + dy as int) y, cast(x + dx as int) x from f, o""")
def _n7o(spark, d):
    return raster.opened(px(spark, d).where("v < 33000").select("image_id", "y", "x"))


@register("n8_partial_target_gradient", f"""with {_GRAD}, {MASK}, {IMAGES}, h as (select distinct image_id, y, x from mask join im using (image_id) where y = 2 or x = 2 or y = height - 3 or x = width - 3)
select g.image_id, g.y, g.x, gx, gy, case when h.y is not null then 0 else g2 end g2 from gg g left join h on g.image_id = h.image_id and g.y = h.y and g.x = h.x""")
def _n8(spark, d):
    return raster.partial_target_gradient(raster.gradients(px(spark, d)), mask(spark, d), images(spark, d).drop("top"), 0.0)


@register("n9_demosaic_green", """with t as (select image_id, y, x, v, lag(v) over wx l, lead(v) over wx r, lag(v) over wy u, lead(v) over wy d from v_pixels window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)),
a as (select *, (coalesce(l, r) + coalesce(r, l))/2.0e0 h, (coalesce(u, d) + coalesce(d, u))/2.0e0 w, abs(coalesce(l - r, 0)) gh, abs(coalesce(u - d, 0)) gv from t)
select image_id, y, x, case when (y % 2)*2 + x % 2 in (1, 2) then v else cast(trunc(coalesce(case when abs(gh - gv) <= 0.0005e0*(gh + gv + 1) or h is null or w is null then (coalesce(h, w) + coalesce(w, h))/2 when gh < gv then h else w end, v)) as int) end v from a""")
def _n9(spark, d):
    return raster.demosaic_green(px(spark, d))


@register("n11_stretch_blend", """with m as (select p.image_id, p.y, p.x, p.v, avg(q.v) mean from v_pixels p join v_pixels q on p.image_id = q.image_id and abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 group by 1, 2, 3, 4)
select image_id, y, x, round(least(0.9e0, greatest(0.4e0, x/32.0e0))*mean + (1 - least(0.9e0, greatest(0.4e0, x/32.0e0)))*v, 5) v from m""")
def _n11(spark, d):
    return rounded(raster.stretch_blend(px(spark, d), F.col("x") / 32.0), "v", digits=5)


@register("h5_autocrop_bounds", """with e as (select * from v_pixels where y % 2 = 0 and x % 2 = 0), s0 as (select image_id, 'row' axis, y as pos, sum(v/65536.0e0) s from e group by 1, 3 union all select image_id, 'column', x, sum(v/65536.0e0) from e group by 1, 3),
pr as (select image_id, axis, cast(pos + o as int) pos, cast(round_even(round(s, 9)*20, 0) as int) v from s0, (select unnest([0, 1]) o)), h as (select image_id, axis, v, count(*) n from pr group by 1, 2, 3),
t as (select image_id, axis, v, cast(sum(n) over w as double) wb, cast(sum(n*v) over w as double) sb, sum(n) over z wt, sum(n*v) over z st from h window w as (partition by image_id, axis order by v), z as (partition by image_id, axis)),
c as (select *, case when wt > wb then wb*(wt - wb)*(sb/wb - (st - sb)/(wt - wb))*(sb/wb - (st - sb)/(wt - wb)) end c from t), b as (select *, max(c) over (partition by image_id, axis) best from c), th as (select image_id, axis, (min(v) + max(v))/2.0e0 th from b where c = best group by 1, 2),
q as (select image_id, axis, min(case when v > th then pos end) a, max(case when v > th then pos end) z, max(pos) e from pr join th using (image_id, axis) group by 1, 2)
select image_id, axis, greatest(0, a - 3) - greatest(0, a - 3) % 2 lo, least(e, z + 3) - least(e, z + 3) % 2 hi from q""")
def _h5(spark, d):
    return raster.autocrop_bounds(rounded(raster.axis_projections(px(spark, d)), "s", digits=9), 3)


_H5 = """with e as (select * from v_pixels where y % 2 = 0 and x % 2 = 0), s0 as (select image_id, 'row' axis, y as pos, sum(v/65536.0e0) s from e group by 1, 3 union all select image_id, 'column', x, sum(v/65536.0e0) from e group by 1, 3),
pr as (select image_id, axis, cast(pos + o as int) pos, cast(round_even(round(s, 9)*20, 0) as int) v from s0, (select unnest([0, 1]) o))"""


def _otsu_sql(source: str, name: str) -> str:
    return f"""h{name} as (select image_id, axis, v, count(*) n from {source} group by 1, 2, 3),
w{name} as (select image_id, axis, v, cast(sum(n) over w as double) wb, cast(sum(n*v) over w as double) sb, sum(n) over z wt, sum(n*v) over z st from h{name} window w as (partition by image_id, axis order by v), z as (partition by image_id, axis)),
c{name} as (select *, case when wt > wb then wb*(wt - wb)*(sb/wb - (st - sb)/(wt - wb))*(sb/wb - (st - sb)/(wt - wb)) end c from w{name}), b{name} as (select *, max(c) over (partition by image_id, axis) best from c{name}),
{name} as (select image_id, axis, (min(v) + max(v))/2.0e0 t from b{name} where c = best group by 1, 2)"""


@register("h5_autocrop_margins", f"""{_H5}, {_otsu_sql("pr", "th")}, p as (select pr.*, t, count(*) over (partition by image_id, axis) n, row_number() over (partition by image_id, axis order by v, pos) - 1 i from pr join th using (image_id, axis)),
f as (select image_id, axis, any_value(n) n, any_value(t) t, least(coalesce(min(pos) filter (v >= t), 1000000), any_value(n) // 4) l1, greatest(coalesce(max(pos) filter (v >= t), 0), 3*any_value(n) // 4) r1, max(v) filter (i = n // 2) med from p group by 1, 2),
g as (select image_id, axis, any_value(f.n) n, any_value(l1) l1, any_value(r1) r1, any_value(med) med, least(coalesce(min(pos) filter (v <= p.t and pos >= l1), 1000000), any_value(f.n) // 4) l2, greatest(coalesce(max(pos) filter (v <= p.t and pos <= r1), 0), 3*any_value(f.n) // 4) r2 from p join f using (image_id, axis) group by 1, 2),
d as (select *, case when l1 < 0.1e0*n then l2 else 0 end lf, case when r1 > 0.9e0*n then r2 else n - 1 end rt from g),
k as (select p.image_id, p.axis, pos, p.v, case when (lf > 0 or rt < d.n - 1) and p.v > p.t then med else p.v end calm, p.t, lf, rt, d.n, lf > 0 or rt < d.n - 1 sk from p join d using (image_id, axis)),
kc as (select image_id, axis, calm v from k), {_otsu_sql("kc", "tj")},
z as (select k.image_id, k.axis, any_value(lf) lf, any_value(rt) rt, any_value(k.n) n, max(pos) filter (v > case when sk then coalesce(tj.t, k.t) else k.t end and pos >= lf) hi, min(pos) filter (v > case when sk then coalesce(tj.t, k.t) else k.t end and pos <= rt and pos > 0) lo from k left join tj using (image_id, axis) group by 1, 2),
o as (select image_id, axis, coalesce(lo, rt) - 3 lo, least(n - 1, coalesce(hi, lf) + 3) hi from z) select image_id, axis, cast(greatest(0, lo + lo % 2) as int) lo, cast(hi - hi % 2 as int) hi from o""")
def _h5_margins(spark, d):
    return raster.autocrop_margins(rounded(raster.axis_projections(px(spark, d)), "s", digits=9), 3)


@register("h6_bar_points", f"""with {IMAGES}, dk as (select image_id, y, x, y - row_number() over (partition by image_id, x order by y) i from v_pixels where v <= 33000), r as (select image_id, x, min(y) a, max(y) z from dk group by image_id, x, i),
k as (select r.*, height, row_number() over (partition by r.image_id, r.x order by a) f, row_number() over (partition by r.image_id, r.x order by z desc) l from r join im using (image_id))
select image_id, 'top' side, x, z + 1 y from k where f = 1 and a < height // 5 and z - a + 1 < floor(0.1e0*height) and z < height - 1 union all select image_id, 'bottom', x, a - 1 from k where l = 1 and z > height - 1 - height // 5 and z - a + 1 < floor(0.1e0*height) and a > 0""")
def _h6_points(spark, d):
    return raster.bar_points(px(spark, d), images(spark, d).drop("top"), 33000, 0.1)


@register("h6_bar_bounds", f"""with {IMAGES}, dk as (select image_id, y, x, y - row_number() over (partition by image_id, x order by y) i from v_pixels where v < 33000), r as (select image_id, x, min(y) y0, count(*) n from dk group by image_id, x, i),
k as (select r.*, row_number() over (partition by r.image_id, r.x order by y0) z from r join im using (image_id) where n < 0.06*height) select image_id, x, y0 y, n from k where z = 1""")
def _h6(spark, d):
    return raster.bar_bounds(px(spark, d), images(spark, d).drop("top"), 33000, 0.06)


@register("n10_demosaic_red_blue")
def _n10(spark, d):
    """Two dependent passes over four windows; the tests hold it against a loop."""
    return raster.demosaic_red_blue(px(spark, d))
