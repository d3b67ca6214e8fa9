"""Queries of the geometry, segmentation and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acutance.operators import geometry, raster, reports
from acutance.plans.curves import rounded
from acutance.plans.rasters import IMAGES, images, px
from acutance.plans.registry import register, view

K = ["block_id"]
#: Directions of the gradients of each raster.
_DIR = """g as (select image_id, y, x, coalesce((lead(v) over wx - lag(v) over wx)/2.0e0, 0) gx, coalesce((lead(v) over wy - lag(v) over wy)/2.0e0, 0) gy from v_pixels
  window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)),
h as (select image_id, cast(least(round_even(72*(atan2(gy, gx) + pi())/(2*pi()), 0), 71) as int) bin, count(*) n from g where gx <> 0 or gy <> 0 group by 1, 2)"""


def directions(spark, d):
    g = raster.gradients(px(spark, d)).where("g2 > 0")
    return g.withColumn("theta", F.atan2("gy", "gx"))


@register("q1_angle_histogram", f"with {_DIR} select * from h")
def _q1(spark, d):
    return geometry.angle_histogram(directions(spark, d), ["image_id"])


@register("q2_circular_peaks", f"""with {_DIR}, s as (select *, n*72 + bin sc from h), b as (select a.image_id, a.bin, a.n, a.sc, max(o.sc) best from s a join s o on a.image_id = o.image_id and (o.bin - a.bin + 144) % 72 in (69, 70, 71, 0, 1, 2) group by 1, 2, 3, 4),
r as (select image_id, bin, n, cast(row_number() over (partition by image_id order by sc desc) as int) rank from b where sc = best) select * from r where rank <= 4""")
def _q2(spark, d):
    return geometry.circular_peaks(geometry.angle_histogram(directions(spark, d), ["image_id"]), ["image_id"])


@register("q5_weighted_pca", """with s as (select image_id, sum(v) s0, sum(v*cast(x as double)) sx, sum(v*cast(y as double)) sy, sum(v*cast(x as double)*x) sxx, sum(v*cast(x as double)*y) sxy, sum(v*cast(y as double)*y) syy from v_pixels group by 1),
m as (select image_id, sx/s0 cx, sy/s0 cy, sxx/s0 - (sx/s0)*(sx/s0) vxx, sxy/s0 - (sx/s0)*(sy/s0) vxy, syy/s0 - (sy/s0)*(sy/s0) vyy from s)
select image_id, round(cx, 6) cx, round(cy, 6) cy, round((vxx + vyy)/2 + sqrt(pow((vxx - vyy)/2, 2) + vxy*vxy), 5) major, round((vxx + vyy)/2 - sqrt(pow((vxx - vyy)/2, 2) + vxy*vxy), 5) minor, round(atan2(2*vxy, vxx - vyy)/2, 6) + 0.0e0 angle from m""")
def _q5(spark, d):
    out = geometry.weighted_pca(px(spark, d).withColumn("w", F.col("v")), ["image_id"])
    return rounded(rounded(out, "cx", "cy", "angle"), "major", "minor", digits=5)


_Q6 = """p as (select edge_id, i % 50 - 25 x, v from v_events), s as (select edge_id, count(*)::double s0, sum(x)::double s1, sum(x*x)::double s2, sum(x*x*x)::double s3, sum(x*x*x*x)::double s4, sum(v) t0, sum(x*v) t1, sum(x*x*v) t2 from p group by 1),
d as (select *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) det from s where s0 >= 3),
fit as (select edge_id, (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0))/det a, (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - s2*t1))/det b,
  (s4*(s2*t0 - s1*t1) - s3*(s3*t0 - s2*t1) + t2*(s3*s1 - s2*s2))/det c from d)"""


def _ridge(spark, d):
    return view(spark, d, "v_events").select("edge_id", (F.col("i") % 50 - 25).alias("x"), "v")


@register("q6_quadratic_fit", f"with {_Q6} select edge_id, round(a, 6) a, round(b, 5) b, round(c, 4) c from fit")
def _q6(spark, d):
    out = geometry.quadratic_fit(_ridge(spark, d), ["edge_id"], y="v")
    return rounded(rounded(rounded(out, "a"), "b", digits=5), "c", digits=4)


#: Blocks of four edges made of the measurements: a turned square round each edge's place.
_BLOCK = """bl as (select edge_id block_id, image_id, ex, ey, 8 + edge_id % 9 r, radians(angle) t from v_edges),
ed as (select block_id, image_id, cast(k as int) k, ex + r*cos(t + k*pi()/2) cx, ey + r*sin(t + k*pi()/2) cy, t + k*pi()/2 + pi()/2 angle, r from bl, (select unnest(range(0, 4)) k))"""


def blocks(spark, d):
    import math

    b = view(spark, d, "v_edges").select(F.col("edge_id").alias("block_id"), "image_id", "ex", "ey", (8 + F.col("edge_id") % 9).alias("r"), F.radians("angle").alias("t"))
    b = b.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("u", F.col("t") + F.col("k") * (math.pi / 2))
    return b.select("block_id", "image_id", "k", (F.col("ex") + F.col("r") * F.cos("u")).alias("cx"), (F.col("ey") + F.col("r") * F.sin("u")).alias("cy"), (F.col("u") + math.pi / 2).alias("angle"), "r")


_CORN = f"""{_BLOCK}, ce as (select block_id, avg(cx) bx, avg(cy) by_ from ed group by 1),
j as (select a.block_id, a.k k1, b.k k2, a.cx x1, a.cy y1, cos(a.angle) c1, sin(a.angle) s1, b.cx x2, b.cy y2, cos(b.angle) c2, sin(b.angle) s2 from ed a join ed b on a.block_id = b.block_id and a.k < b.k),
t as (select *, ((x2 - x1)*s2 - (y2 - y1)*c2)/(c1*s2 - s1*c2) tt from j where abs(c1*c2 + s1*s2) < 0.866),
pt as (select t.block_id, k1, k2, x1 + tt*c1 x, y1 + tt*s1 y, bx, by_ from t join ce using (block_id)),
rk as (select *, row_number() over (partition by block_id order by round(pow(x - bx, 2) + pow(y - by_, 2), 6), k1, k2) n from pt),
co as (select block_id, k1, k2, x, y, cast(row_number() over (partition by block_id order by round(-atan2(y - by_, x - bx), 9), k1, k2) as int) corner from rk where n <= 4)"""


@register("q8_corners", f"with {_CORN} select block_id, k1, k2, round(x, 5) x, round(y, 5) y, corner from co")
def _q8(spark, d):
    return rounded(geometry.corners(blocks(spark, d), K), "x", "y", digits=5)


@register("q9_quad_area_gate", f"""with {_CORN}, nx as (select a.block_id, a.x, a.y, b.x nx, b.y ny from co a join co b on a.block_id = b.block_id and a.corner = b.corner % 4 + 1),
q as (select block_id, min(sqrt(pow(x - nx, 2) + pow(y - ny, 2))) ms, abs(sum(x*ny - nx*y))/2 ar from nx group by 1 having count(*) = 4)
select block_id, round(ms, 5) min_side, round(ar, 4) area, round(ms, 6) > 16 and round(ar, 6) > 300 ok from q""")
def _q9(spark, d):
    out = geometry.quad_area(geometry.corners(blocks(spark, d), K), K, 16.000001, 300.000001)
    return rounded(rounded(out, "min_side", digits=5), "area", digits=4)


_POOL = f"{_BLOCK}, pe as (select block_id, k, case when k % 2 = 0 then angle + 0.01e0*k else angle end angle, 0.1e0*(block_id % 7) + 0.01e0*k*(block_id % 5) slope, 0.01e0 + 0.002e0*k se from ed)"


_PAIRS = """p as (select a.block_id, a.k k1, b.k k2, round(1 - abs(cos(a.angle - b.angle)), 9) off_, abs(case when abs(a.slope) > 2 then 1/a.slope - 1/b.slope else a.slope - b.slope end)/sqrt(a.se*a.se + b.se*b.se) z from pe a join pe b on a.block_id = b.block_id and a.k < b.k where abs(cos(a.angle - b.angle)) > 0.80902),
q as (select *, row_number() over (partition by block_id order by off_, k1, k2) r from p where z < 1.66), b as (select block_id, k1 b1, k2 b2 from q where r = 1),
o as (select q.*, row_number() over (partition by q.block_id order by off_, k1, k2) r2 from q join b using (block_id) where k1 not in (b1, b2) and k2 not in (b1, b2)),
pr as (select block_id, k1, k2, z from q where r = 1 union all select block_id, k1, k2, z from o where r2 = 1)"""


@register("q14_pool_edges", f"with {_POOL}, {_PAIRS} select block_id, k1, k2, round(z, 6) z from pr")
def _q14(spark, d):
    b = blocks(spark, d).select("block_id", "k", F.when(F.col("k") % 2 == 0, F.col("angle") + 0.01 * F.col("k")).otherwise(F.col("angle")).alias("angle"), (0.1 * (F.col("block_id") % 7) + 0.01 * F.col("k") * (F.col("block_id") % 5)).alias("slope"), (0.01 + 0.002 * F.col("k")).alias("se"))
    return rounded(geometry.pool_edges(b, K), "z")


#: Points of each side: 21 along it, off by up to 0.4 pixels by their number, weighed by the edge's value.
_SIDES = f"""{_BLOCK}, sp as (select ed.block_id, k, t*cos(ed.angle) - e*sin(ed.angle) x, t*sin(ed.angle) + e*cos(ed.angle) y, 0.5e0 + mtf w from
  (select block_id, k, angle, i - 10 t, ((block_id*7919 + k*331 + i*i*613 + i*(31 + k)) % 1009 - 504)*8e-4 e from ed, (select unnest(range(0, 21)) i)) ed join v_edges on edge_id = block_id),
mo as (select block_id, k, sum(w) s0, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my, sum(w*x*x)/sum(w) xx, sum(w*x*y)/sum(w) xy, sum(w*y*y)/sum(w) yy from sp group by 1, 2),
ms as (select block_id, k, s0, xx - mx*mx vxx, xy - mx*my vxy, yy - my*my vyy from mo), an as (select *, atan2(2*vxy, vxx - vyy)/2 angle, sqrt(pow((vxx - vyy)/2, 2) + vxy*vxy) rt from ms),
pe as (select *, tan(angle) slope, sqrt(greatest((vxx + vyy)/2 - rt, 0)/((vxx + vyy)/2 + rt)/s0) se from an)"""


def side_moments(spark, d):
    p = blocks(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).join(view(spark, d, "v_edges").select(F.col("edge_id").alias("block_id"), "mtf"), "block_id")
    k, i, t = F.col("k"), F.col("i"), F.col("i") - 10
    e = ((F.col("block_id") * 7919 + k * 331 + i * i * 613 + i * (31 + k)) % 1009 - 504) * 8e-4
    c, s = F.cos("angle"), F.sin("angle")
    m = geometry.weighted_moments(p.select("block_id", "k", (t * c - e * s).alias("x"), (t * s + e * c).alias("y"), (0.5 + F.col("mtf")).alias("w")), [*K, "k"])
    return m.withColumn("angle", geometry.principal_axes()[2])


@register("q14_pool_angles", f"""with {_SIDES}, {_PAIRS}, bo as (select block_id, k1 k, k2 o from pr union all select block_id, k2, k1 from pr),
j as (select a.block_id, a.k, a.angle, bo.o, atan2(2*(a.s0*a.vxy + c.s0*c.vxy), a.s0*a.vxx + c.s0*c.vxx - a.s0*a.vyy - c.s0*c.vyy)/2 ax from pe a left join bo on a.block_id = bo.block_id and a.k = bo.k left join pe c on c.block_id = bo.block_id and c.k = bo.o),
t as (select *, (ax - angle + pi()/2) % pi() m from j)
select block_id, k, round(case when o is null then angle else angle + case when m < 0 then m + pi() else m end - pi()/2 end, 6) + 0.0e0 angle, o is not null pooled from t""")
def _q14_angles(spark, d):
    return rounded(geometry.pool_angles(side_moments(spark, d), K), "angle")


@register("q16_snap_angle", """with o as (select unnest([10, -10, 100, 80, -80, -100, 190, 170]) o, unnest(range(0, 8)) i), r as (select edge_id, o, row_number() over (partition by edge_id order by round(cos(radians(angle - o)), 12) desc, i) n from v_edges, o) select edge_id, cast(o as double) angle from r where n = 1""")
def _q16(spark, d):
    return geometry.snap_angle(view(spark, d, "v_edges"), 10.0).select("edge_id", "angle")


@register("q17_reduce_angle", "with e as (select edge_id, degrees(abs(radians(angle) % (pi()/2))) a from v_edges) select edge_id, round(case when a > 45 then 90 - a else a end, 6) reduced_angle from e")
def _q17(spark, d):
    return rounded(view(spark, d, "v_edges").select("edge_id", reports.reduce_angle(F.radians("angle")).alias("reduced_angle")), "reduced_angle")


@register("q18_block_sides", f"""with {_BLOCK}, r as (select *, row_number() over (partition by block_id order by cy, k) a, row_number() over (partition by block_id order by cy desc, k desc) b,
  row_number() over (partition by block_id order by cx, k) c, row_number() over (partition by block_id order by cx desc, k desc) e from ed)
select block_id, round(avg(cx), 6) bx, round(avg(cy), 6) by_, max(case when a = 1 then k end) top, max(case when b = 1 then k end) bottom, max(case when c = 1 then k end) "left", max(case when e = 1 then k end) "right" from r group by 1""")
def _q18(spark, d):
    return rounded(geometry.block_sides(blocks(spark, d), K), "bx", "by_")


@register("q20_geometric_length", f"""with {_CORN}, n as (select ed.block_id, ed.k, co.x, co.y, row_number() over (partition by ed.block_id, ed.k order by round(pow(co.x - ed.cx, 2) + pow(co.y - ed.cy, 2), 6), corner) r from ed join co using (block_id))
select a.block_id, a.k, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 5) length from n a join n b on a.block_id = b.block_id and a.k = b.k and a.r = 1 and b.r = 2""")
def _q20(spark, d):
    b = blocks(spark, d)
    return rounded(geometry.geometric_length(b, geometry.corners(b, K), K), "length", digits=5)


LINE_DEVIATION_SQL = f"""with {_Q6}, f2 as (select edge_id, x, round(round(a, 6)*x*x + round(b, 5)*x + round(c, 4), 6) p from p join fit using (edge_id)),
r as (select *, row_number() over (partition by edge_id order by p, x) lo, row_number() over (partition by edge_id order by p desc, x desc) hi from f2),
e as (select edge_id, max(case when lo = 1 then p end) pl, max(case when lo = 1 then x end) xl, max(case when hi = 1 then p end) ph, max(case when hi = 1 then x end) xh from r group by 1)
select edge_id, round(ph - pl, 5) rise, abs(xh - xl) run, round(case when xh <> xl then (ph - pl)/abs(xh - xl) else 0 end, 6) slope from e"""


@register("q22_line_deviation", LINE_DEVIATION_SQL)
def _q22(spark, d):
    out = geometry.line_deviation(_ridge(spark, d), _q6(spark, d), ["edge_id"])
    return rounded(rounded(out, "rise", digits=5), "slope")


_WIN = "ln as (select edge_id, min(par) lo, max(par) hi from v_samples group by 1), wi as (select edge_id, cast(w as int) win, lo + w*4.0e0 w0 from ln, (select unnest(range(0, 100)) w) where hi - lo >= 40 and w <= floor((hi - lo - 40)/4))"


def _windows(spark, d, plain=False):
    e = view(spark, d, "v_samples").groupBy("edge_id").agg(F.min("par").alias("lo"), F.max("par").alias("hi"))
    return geometry.sliding_windows(e, ["edge_id"]).drop("step") if plain else geometry.sliding_windows(e, ["edge_id"])


@register("q23_sliding_windows", f'with {_WIN} select edge_id, win as "window", w0, w0 + 40 w1 from wi')
def _q23(spark, d):
    return _windows(spark, d, plain=True)


@register("q24_window_samples", f'with {_WIN} select w.edge_id, win as "window", count(*) n, round(avg(v), 3) mean from wi w join v_samples s on s.edge_id = w.edge_id and s.par between w0 and w0 + 40 group by 1, 2')
def _q24(spark, d):
    s = geometry.window_samples(_windows(spark, d), view(spark, d, "v_samples"), ["edge_id"])
    return rounded(s.groupBy("edge_id", "window").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean", digits=3)


@register("q26_gradient_outliers", """with r as (select edge_id, perp, par, v, row_number() over (partition by edge_id, floor(perp*2) order by v, perp, par) k, count(*) over (partition by edge_id, floor(perp*2)) n, max(v) over (partition by edge_id, floor(perp*2)) top from v_samples),
s as (select *, max(case when k = n - 1 then v end) over (partition by edge_id, floor(perp*2)) sec from r)
select edge_id, count(*) n, round(sum(v), 2) s from s where not (abs(perp) > 2 and n > 3 and top - sec >= 0.001 and k > floor(n*0.95e0)) group by 1""")
def _q26(spark, d):
    kept = geometry.gradient_outliers(view(spark, d, "v_samples").withColumnRenamed("v", "g2"), ["edge_id"])
    return rounded(kept.groupBy("edge_id").agg(F.count("*").alias("n"), F.sum("g2").alias("s")), "s", digits=2)


# Segmentation

MASK = "mk as (select image_id, y, x from v_pixels where v < 31000)"
_RUN = f"{MASK}, isl as (select *, x - row_number() over (partition by image_id, y order by x) i from mk), ru as (select image_id, y, min(x) x0, max(x) x1 from isl group by image_id, y, i), rn as (select *, y*4294967296 + x0 run from ru)"
_CC = f"""{_RUN}, tc as (select a.image_id, a.run a, b.run b from rn a join rn b on a.image_id = b.image_id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
cl as (select image_id, run, run lab from rn union select tc.image_id, tc.b, cl.lab from cl join tc on tc.image_id = cl.image_id and tc.a = cl.run where cl.lab < tc.b),
lb as (select image_id, run, min(lab) label from cl group by 1, 2), cp as (select rn.image_id, label, y, cast(x as int) x from rn join lb on rn.image_id = lb.image_id and rn.run = lb.run, (select unnest(range(0, 32)) x) where x between x0 and x1)"""
_BD = f"""{_CC}, bd as (select c.image_id, c.label, c.y, c.x from cp c left join cp o on c.image_id = o.image_id and c.label = o.label and abs(c.y - o.y) + abs(c.x - o.x) = 1 group by 1, 2, 3, 4 having count(o.y) < 4)"""


def mask(spark, d):
    return px(spark, d).where("v < 31000").select("image_id", "y", "x")


def comps(spark, d):
    return geometry.component_pixels(geometry.connected_components(geometry.runs(mask(spark, d))))


@register("c1_runs", f"with {_RUN} select image_id, y, x0, x1, run from rn")
def _c1(spark, d):
    return geometry.runs(mask(spark, d))


@register("c2_connected_components", f"with recursive {_CC} select image_id, label, y, x from cp")
def _c2(spark, d):
    return comps(spark, d)


@register("c3_boundaries", f"with recursive {_BD} select * from bd")
def _c3(spark, d):
    return geometry.boundaries(comps(spark, d))


@register("c4_filter_by_boundary", f"with recursive {_BD}, im as (select image_id, max(x) + max(y) + 2 sides from v_pixels group by 1), k as (select image_id, label from bd join im using (image_id) group by 1, 2 having count(*) between 8 and greatest(8000, 0.8e0*any_value(sides))) select bd.* from bd join k using (image_id, label)")
def _c4(spark, d):
    sizes = view(spark, d, "v_pixels").groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return geometry.filter_by_boundary(geometry.boundaries(comps(spark, d)), sizes, 8)


@register("c6_inflate_boundaries", f"""with recursive {_BD}, ct as (select image_id, label, avg(x) cx, avg(y) cy, count(*) n from bd group by 1, 2)
select image_id, label, cast(case when n > 20 then round_even(y + 2*(y - cy)/greatest(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 1e-9), 0) else y end as int) y, cast(case when n > 20 then round_even(x + 2*(x - cx)/greatest(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 1e-9), 0) else x end as int) x from bd join ct using (image_id, label)""")
def _c6(spark, d):
    return geometry.inflate_boundaries(geometry.boundaries(comps(spark, d)), 2.0, 20)


@register("c7_component_centroid", f"with recursive {_BD} select image_id, label, round(avg(x), 6) cx, round(avg(y), 6) cy, count(*) n from bd group by 1, 2")
def _c7(spark, d):
    return rounded(geometry.component_centroid(geometry.boundaries(comps(spark, d))), "cx", "cy")


@register("c8_reject_frame_touching", f"with recursive {_BD}, {IMAGES}, bad as (select distinct image_id, label from bd join im using (image_id) where x <= 4 or y <= 4 or x >= width - 5 or y >= height - 5) select bd.* from bd left join bad using (image_id, label) where bad.label is null")
def _c8(spark, d):
    return geometry.reject_frame_touching(geometry.boundaries(comps(spark, d)), images(spark, d).drop("top"))


# Sampling

_ROW = "rr as (select image_id, y % 4 edge_id, y, min(x) x0, max(x) x1 from v_pixels where v < 36000 group by 1, 2, 3)"
_EP = f"{_ROW}, ep as (select p.image_id, rr.edge_id, p.y, p.x, p.v from rr join v_pixels p on p.image_id = rr.image_id and p.y = rr.y and p.x between x0 and x1)"
_SL = f"""{_EP}, sl as (select image_id, edge_id, (y - 20)*cos(0.1e0*(edge_id + 1)) - (x - 16)*sin(0.1e0*(edge_id + 1)) perp, (x - 16)*cos(0.1e0*(edge_id + 1)) + (y - 20)*sin(0.1e0*(edge_id + 1)) par, v from ep),
sm as (select * from sl where abs(perp) < 12 and abs(par) < 14)"""
EK = ["image_id", "edge_id"]


def ep(spark, d):
    p = px(spark, d)
    rows = geometry.roi_rows(p.where("v < 36000").withColumn("edge_id", F.col("y") % 4), EK)
    return geometry.edge_pixels(p, rows, ["edge_id"])


def sampled(spark, d):
    lines = px(spark, d).select("image_id").distinct().withColumn("edge_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"cx": F.lit(16.0), "cy": F.lit(20.0), "angle": 0.1 * (F.col("edge_id") + 1)})
    return geometry.sample_line(ep(spark, d), lines, EK, 12.0, 14.0)


@register("j1_roi_rows", f"with {_ROW} select * from rr")
def _j1(spark, d):
    return geometry.roi_rows(px(spark, d).where("v < 36000").withColumn("edge_id", F.col("y") % 4), EK)


@register("j2_edge_pixels", f"with {_EP} select * from ep")
def _j2(spark, d):
    return ep(spark, d)


@register("j3_sample_line", f"with {_SL} select image_id, edge_id, round(perp, 6) + 0.0e0 perp, round(par, 6) + 0.0e0 par, v from sm")
def _j3(spark, d):
    return rounded(sampled(spark, d), "perp", "par")


@register("j4_sample_quadratic", f"""with {_EP},
q as (select image_id, edge_id, y, x, v, x - 16 px, y - 20 - 0.5e0*edge_id py, 0.004e0*(edge_id + 1) a from ep)
select image_id, edge_id, count(*) n, sum(v) sv, sum(case when py >= a*px*px + 0.1e0*px then 1 else 0 end) above from q group by 1, 2""")
def _j4(spark, d):
    """Counts by side; the distances themselves are held against a dense search in the tests."""
    pts = ep(spark, d).select("image_id", "edge_id", (F.col("x") - 16).alias("x"), (F.col("y") - 20 - 0.5 * F.col("edge_id")).alias("y"), "v")
    fits = px(spark, d).select("image_id").distinct().withColumn("edge_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"a": 0.004 * (F.col("edge_id") + 1), "b": F.lit(0.1), "c": F.lit(0.0)})
    s = geometry.sample_quadratic(pts, fits, EK)
    return s.groupBy(*EK).agg(F.count("*").alias("n"), F.sum("v").alias("sv"), F.sum((F.col("perp") >= 0).cast("int")).alias("above"))


@register("j8_edge_length", f"with {_SL} select image_id, edge_id, round(max(par) - min(par), 6) length from sm group by 1, 2")
def _j8(spark, d):
    return rounded(geometry.edge_length(sampled(spark, d), EK), "length")


@register("j9_min_samples", f"with {_SL}, k as (select image_id, edge_id from sm group by 1, 2 having count(*) >= 100) select image_id, edge_id, round(perp, 6) + 0.0e0 perp, round(par, 6) + 0.0e0 par, v from sm join k using (image_id, edge_id)")
def _j9(spark, d):
    return rounded(geometry.min_samples(sampled(spark, d), EK, 100), "perp", "par")


@register("q11_reposition", f"""with {_BLOCK}, ce as (select block_id, avg(cx) bx, avg(cy) by_ from ed group by 1), n as (select ed.*, bx, by_, -sin(angle) nx, cos(angle) ny from ed join ce using (block_id))
select block_id, k, round(case when (cx - bx)*nx + (cy - by_)*ny < 0 then -nx else nx end, 6) + 0.0e0 nx, round(case when (cx - bx)*nx + (cy - by_)*ny < 0 then -ny else ny end, 6) + 0.0e0 ny from n""")
def _q11(spark, d):
    return rounded(geometry.reposition(blocks(spark, d), K), "nx", "ny")


@register("q15_recentre", f"with {_BLOCK} select block_id, k, round(cx + case when block_id % 3 = 0 then 4 else 0.5e0 end, 6) cx, round(cy, 6) cy, block_id % 3 = 0 again from ed")
def _q15(spark, d):
    b = blocks(spark, d)
    moved = b.withColumn("cx", F.col("cx") + F.when(F.col("block_id") % 3 == 0, 2.0).otherwise(0.5)).withColumn("again", F.lit(False))
    out = geometry.recentre(b, moved, ["block_id", "k"], lambda rows: rows.withColumn("cx", F.col("cx") + 2).withColumn("again", F.lit(True)))
    return rounded(out.select("block_id", "k", "cx", "cy", "again"), "cx", "cy")


@register("q19_pair_edges_with_corners", f"""with {_CORN}, mc as (select block_id, avg(x) mx, avg(y) my from co group by 1),
o as (select co.*, row_number() over (partition by co.block_id order by round((atan2(x - mx, my - y) % (2*pi()) + 2*pi()) % (2*pi()), 9), corner) n from co join mc using (block_id)),
sg as (select a.block_id, a.n, a.x, a.y, b.x x2, b.y y2 from o a join o b on a.block_id = b.block_id and b.n = a.n % 4 + 1),
q as (select sg.*, k, row_number() over (partition by sg.block_id, n order by round(pow(cx - (x + x2)/2, 2) + pow(cy - (y + y2)/2, 2), 6), k) r from sg join ed using (block_id))
select block_id, cast(n as int) n, round(x, 5) x, round(y, 5) y, k from q where r = 1""")
def _q19(spark, d):
    b = blocks(spark, d)
    return rounded(geometry.pair_edges_with_corners(b, geometry.corners(b, K), K), "x", "y", digits=5)


@register("q25_roi_measure_prep", f"""with rois as (select image_id, edge_id roi_id, ex % 32 ax, ey % 48 ay, (ex + edge_id) % 32 + 1.5e0 bx, ey % 37 as by_ from v_edges), l as (select *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) len from rois),
gr as (select image_id, y, x, coalesce((lead(v) over wx - lag(v) over wx)/2.0e0, 0) gx, coalesce((lead(v) over wy - lag(v) over wy)/2.0e0, 0) gy from v_pixels window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)),
j as (select g.image_id, roi_id, y, x, gx*gx + gy*gy g2, len, (x - ax)*(bx - ax)/len + (y - ay)*(by_ - ay)/len par, (y - ay)*(bx - ax)/len - (x - ax)*(by_ - ay)/len perp from gr g join l using (image_id)),
f as (select * from j where par between 0 and len and abs(perp) <= 8), r as (select *, row_number() over (partition by image_id, roi_id, floor(perp*2) order by g2, perp, par) k, count(*) over (partition by image_id, roi_id, floor(perp*2)) n, max(g2) over (partition by image_id, roi_id, floor(perp*2)) top from f),
s as (select *, max(case when k = n - 1 then g2 end) over (partition by image_id, roi_id, floor(perp*2)) sec from r), c as (select * from s where g2 > 0 and not coalesce(abs(perp) > 2 and n > 3 and top - sec >= 0.001 and k > floor(n*0.95e0), false)),
m as (select image_id, roi_id, sum(g2*x)/sum(g2) cx, sum(g2*y)/sum(g2) cy from c group by 1, 2) select image_id, roi_id, round(cx, 4) cx, round(cy, 4) cy from m""")
def _q25(spark, d):
    from acutance.plans.rasters import rois

    out = geometry.roi_measure_prep(px(spark, d), rois(spark, d), 8.0)
    return rounded(out.select("image_id", "roi_id", "cx", "cy"), "cx", "cy", digits=4)


def _bent_ridge(spark, d):
    """Ridges of two parabolas joined at 10, one for each edge."""
    e = view(spark, d, "v_edges").withColumn("x", F.explode(F.sequence(F.lit(-30), F.lit(50)))).withColumn("x", F.col("x").cast("double"))
    u = F.col("x") - 10
    y = 1 + 0.1 * u + F.when(u < 0, -0.004).otherwise(0.006) * (1 + F.col("edge_id") % 3) * u * u
    return e.select("edge_id", "x", y.alias("y"))


@register("j5_piecewise_fit", "select edge_id, 10.0e0 t, 1.0e0 c, 0.1e0 b, round(-0.004e0*(1 + edge_id % 3), 6) a1, round(0.006e0*(1 + edge_id % 3), 6) a2 from v_edges")
def _j5(spark, d):
    """The planted coefficients come back where the knot is found at a bin's border."""
    from acutance.operators import sampling

    out = sampling.piecewise_fit(_bent_ridge(spark, d), ["edge_id"])
    return rounded(out, "t", "c", "b", "a1", "a2")


@register("j6_sample_piecewise")
def _j6(spark, d):
    from acutance.operators import sampling

    pts = px(spark, d).select((F.col("image_id") * 10 + 5).alias("edge_id"), (F.col("x") - 8).cast("double").alias("x"), (F.col("y") - 20).cast("double").alias("y"), "v")
    out = sampling.sample_piecewise(pts, sampling.piecewise_fit(_bent_ridge(spark, d), ["edge_id"]), ["edge_id"])
    return rounded(out, "perp", "par")


@register("j7_sample_deferred")
def _j7(spark, d):
    from acutance.operators import lens, sampling

    e = px(spark, d).select("image_id").distinct().withColumns({"cx": F.lit(2.0), "cy": F.lit(1.0), "angle": 0.3 + 0.1 * F.col("image_id")})
    pts = px(spark, d).select("image_id", (F.col("x") - 16).cast("double").alias("x"), (F.col("y") - 24).cast("double").alias("y"), "v")
    return rounded(sampling.sample_deferred(pts, e, ["image_id"], lambda rows: lens.equiangular(rows, 200.0)), "perp", "par", digits=5)
