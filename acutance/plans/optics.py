"""Queries of the lens and chart operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acutance.operators import charts, focus, lens
from acutance.plans.curves import rounded
from acutance.plans.registry import register, view
from acutance.plans.rasters import px
from acutance.plans.shapes import _CC
from acutance.session import read_table


def pts(spark, d):
    """Edge places relative to the centre, the corner at radius 1."""
    return view(spark, d, "v_edges").select("edge_id", "image_id", ((F.col("ex") - 320) / 400).alias("x"), ((F.col("ey") - 240) / 400).alias("y"))


P = "p as (select edge_id, image_id, (ex - 320)/400.0e0 x, (ey - 240)/400.0e0 y from v_edges), r as (select *, sqrt(x*x + y*y) r from p)"


def _radial(name: str, to: str, fn):
    @register(name, f"with {P}, s as (select *, {to} t from r) select edge_id, round(x*case when r > 0 then t/r else 1 end, 7) + 0.0e0 x, round(y*case when r > 0 then t/r else 1 end, 7) + 0.0e0 y from s")
    def _q(spark, d):
        return rounded(fn(pts(spark, d)), "x", "y", digits=7).select("edge_id", "x", "y")


_radial("l1_equiangular", "1.5e0*atan(r/1.5e0)", lambda p: lens.equiangular(p, 1.5))
_radial("l1_equiangular_inverse", "1.5e0*tan(r/1.5e0)", lambda p: lens.equiangular(p, 1.5, True))
_radial("l2_stereographic", "3.0e0*tan(atan(r/1.5e0)/2)", lambda p: lens.stereographic(p, 1.5))
_radial("l2_stereographic_inverse", "1.5e0*tan(2*atan(r/3.0e0))", lambda p: lens.stereographic(p, 1.5, True))
_radial("l3_division_inverse", "r/(1 - 0.1e0*r*r + 0.02e0*r*r*r*r)", lambda p: lens.division_inverse(p, F.lit(-0.1), F.lit(0.02)))
_radial("l4_division_forward", "2*r/(1 + sqrt(greatest(1 + 0.4e0*r*r, 0)))", lambda p: lens.division_forward(p, -0.1))


@register("l5_radial_table", f"""with {P}, q as (select *, greatest(1, cast(round_even(r/0.05e0, 0) as int)) i from r), w as (select edge_id, i, r/0.05e0 - i t, d from q, (select unnest([-1, 0, 1]) d))
select edge_id point_id, round(sum((case d when -1 then t*(t - 1)/2 when 0 then 1 - t*t else t*(t + 1)/2 end)*1.5e0*atan((i + d)*0.05e0/1.5e0)), 7) rd from w group by 1""")
def _l5(spark, d):
    p = pts(spark, d).select("image_id", F.col("edge_id").alias("point_id"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("radius"))
    table = lens.radial_table(p.select("image_id").distinct(), lambda r: 1.5 * F.atan(r / 1.5), 0.05, 1.1)
    return rounded(lens.table_lookup(p, table, ["image_id"], 0.05), "rd", digits=7).select("point_id", "rd")


@register("l6_remap", """with t as (select image_id, y, x, y*0.9e0 + 1.3e0 sy, x*0.95e0 - 0.4e0 sx from v_pixels), c as (select t.*, a, b, (case when a = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end)*(case when b = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) w from t, (select unnest([0, 1]) a), (select unnest([0, 1]) b))
select c.image_id, c.y, c.x, round(sum(w*coalesce(p.v, 0)), 4) v from c left join v_pixels p on p.image_id = c.image_id and p.y = floor(sy) + a and p.x = floor(sx) + b group by 1, 2, 3""")
def _l6(spark, d):
    p = px(spark, d)
    return rounded(lens.remap(p, p.select("image_id", "y", "x", (F.col("y") * 0.9 + 1.3).alias("sy"), (F.col("x") * 0.95 - 0.4).alias("sx"))), "v", digits=4)


@register("l7_warp_padding", """with i as (select image_id, 300.0e0 + 100*image_id f from (select distinct image_id from v_edges)), s as (select image_id, r from i, (select unnest(range(0, 3001)) r) where 500.0e0*(atan((r + 80)/500.0e0) - atan(r/500.0e0)) < 20),
m as (select i.image_id, coalesce(min(s.r), 3000) r from i left join s using (image_id) group by 1) select image_id, cast(r - r % 2 as int) padding from m""")
def _l7(spark, d):
    return lens.warp_padding(view(spark, d, "v_edges").select("image_id").distinct(), 500.0, cap=3000)


_RG = """ra as (select edge_id ridge_id, image_id, cast(i as int) seq, i - 20 t, (ex - 320)/400.0e0 cx, (ey - 240)/400.0e0 cy, radians(angle) a, mtf from v_edges, (select unnest(range(0, 41)) i)),
rs as (select ridge_id, image_id, seq, mtf, cx + t/100.0e0*cos(a) ux, cy + t/100.0e0*sin(a) uy from ra), rx as (select *, ux*ux + uy*uy u2 from rs),
rg as (select ridge_id, image_id, seq, ux*2/(1 + sqrt(1 + 0.4e0*u2)) x, uy*2/(1 + sqrt(1 + 0.4e0*u2)) + ((ridge_id*7919 + seq*seq*613 + ridge_id*seq*31) % 1009 - 504)*1e-7*(0.5e0 + mtf) y from rx)"""


def ridge(spark, d):
    """Straight lines through the edges' places, bent by the division model with k1 = -0.1; places off by up to 0.03 pixels, more for larger values."""
    r = view(spark, d, "v_edges").withColumn("seq", F.explode(F.array(*[F.lit(i) for i in range(41)])))
    t, a = (F.col("seq") - 20) / 100.0, F.radians("angle")
    r = r.select(F.col("edge_id").alias("ridge_id"), "image_id", "seq", "mtf", ((F.col("ex") - 320) / 400 + t * F.cos(a)).alias("x"), ((F.col("ey") - 240) / 400 + t * F.sin(a)).alias("y"))
    off = ((F.col("ridge_id") * 7919 + F.col("seq") * F.col("seq") * 613 + F.col("ridge_id") * F.col("seq") * 31) % 1009 - 504) * 1e-7 * (0.5 + F.col("mtf"))
    return lens.division_forward(r, -0.1).withColumn("y", F.col("y") + off).drop("mtf")


@register("l8_select_ridges", f"with {_RG}, k as (select edge_id ridge_id from v_edges where abs(cos(radians(angle))) > 0.5) select ridge_id, image_id, seq, round(x, 7) x, round(y, 7) y from rg join k using (ridge_id) where seq % 3 = 0")
def _l8(spark, d):
    ang = view(spark, d, "v_edges").select(F.col("edge_id").alias("ridge_id"), F.cos(F.radians("angle")).alias("cos_radial"))
    return rounded(lens.select_ridges(ridge(spark, d), ang, ["ridge_id"], 0.5), "x", "y", digits=7)


_L9 = f"""{_RG}, cd as (select cast(a*3 + b as int) cand, -0.2e0 + 0.1e0*a k1, -0.02e0 + 0.02e0*b k2 from (select unnest(range(0, 3)) a), (select unnest(range(0, 3)) b)),
ch as (select *, lag(x) over w xb, lag(y) over w yb, first_value(x) over w x0, first_value(y) over w y0, last_value(x) over w x1, last_value(y) over w y1 from rg window w as (partition by ridge_id order by seq rows between unbounded preceding and unbounded following)),
dr as (select *, (x1 - x0)/sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) c, (y1 - y0)/sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) s, x*x + y*y r2, xb*xb + yb*yb rb from ch),
w1 as (select cand, ridge_id, seq, c, s, x/(1 + k1*r2 + k2*r2*r2) - x0 dx, y/(1 + k1*r2 + k2*r2*r2) - y0 dy, xb/(1 + k1*rb + k2*rb*rb) - x0 bx, yb/(1 + k1*rb + k2*rb*rb) - y0 by_ from dr, cd),
uv as (select cand, ridge_id, seq, dx*c + dy*s u, dy*c - dx*s v, bx*c + by_*s ub, by_*c - bx*s vb from w1),
li as (select cand, ridge_id, regr_slope(v, u) b, regr_intercept(v, u) a from uv group by 1, 2),
er as (select cand, ridge_id, seq, v - a - b*u e, vb - a - b*ub eb from uv join li using (cand, ridge_id)),
rt as (select cand, ridge_id, sum(e*e)/sum(pow(e - eb, 2)) t from er group by 1, 2)"""


@register("l9_straightness", f"with {_L9} select cand, round(avg(t), 6) cost from rt group by 1")
def _l9(spark, d):
    cand = spark.createDataFrame([(a * 3 + b, -0.2 + 0.1 * a, -0.02 + 0.02 * b) for a in range(3) for b in range(3)], "cand int, k1 double, k2 double")
    return rounded(lens.straightness(ridge(spark, d), cand, ["ridge_id"]), "cost")


@register("l10_invertible", f"""with {P}, k as (select edge_id, x*3 k1, y k2 from p), v as (select *, -k1/(6*k2) s from k)
select edge_id, (1 - k1*1.21e0 - 3*k2*1.21e0*1.21e0 > 0) and (case when k2 < 0 and s > 0 and s < 1.21e0 then 1 - k1*s - 3*k2*s*s else 1 end > 0) ok from v where k2 <> 0""")
def _l10(spark, d):
    p = pts(spark, d).where("y <> 0")
    return p.select("edge_id", lens.invertible(F.col("x") * 3, F.col("y"), 1.1).alias("ok"))


@register("l11_fit_distortion")
def _l11(spark, d):
    """Planted k1 = -0.1, k2 = 0: what the fit of each image's lens found (tests compare)."""
    return lens.fit_distortion(ridge(spark, d), ["ridge_id"], ["image_id"], rounds=7).select("image_id", "k1", "k2", "ridges", "dropped")


@register("l12_medcouple_outliers", """with r as (select *, row_number() over (partition by image_id order by mtf, edge_id) - 1 i, count(*) over (partition by image_id) n from v_edges),
q as (select image_id, any_value(n) n, max(mtf) filter (i = n // 2) m, max(mtf) filter (i = cast(floor(n*0.25e0) as int)) q1, max(mtf) filter (i = cast(floor(n*0.75e0) as int)) q3 from r group by 1),
a as (select image_id, mtf - m z, row_number() over (partition by image_id order by i desc) - 1 k, count(*) over (partition by image_id) p from r join q using (image_id) where mtf >= m and i > 0),
b as (select image_id, mtf - m z, row_number() over (partition by image_id order by i) - 1 k from r join q using (image_id) where mtf <= m),
h as (select image_id, case when a.z = b.z then sign(p - 1 - a.k - b.k) else (a.z + b.z)/(a.z - b.z) end h from a join b using (image_id)),
o as (select image_id, h, row_number() over (partition by image_id order by h) - 1 k, count(*) over (partition by image_id) c from h), mc as (select image_id, h mc from o where k = c // 2)
select edge_id, image_id, n > 4 and mtf >= q3 + 1.5e0*exp(4*mc)*(q3 - q1) outlier from v_edges join q using (image_id) join mc using (image_id)""")
def _l12(spark, d):
    out = lens.medcouple_outliers(view(spark, d, "v_edges").withColumn("e", F.col("mtf")), ["image_id"])
    return out.select("edge_id", "image_id", "outlier")


# Charts

_F = """f as (select cast(image_id as int) image_id, edge_id fid, ex cx, ey cy, 6 + edge_id % 40 as minor, 8 + edge_id % 45 major, case when edge_id < 8 then 0 else edge_id % 21 end code from v_edges)"""


def fids(spark, d):
    e = view(spark, d, "v_edges")
    return e.select("image_id", F.col("edge_id").alias("fid"), F.col("ex").alias("cx"), F.col("ey").alias("cy"), (6 + F.col("edge_id") % 40).alias("minor"), (8 + F.col("edge_id") % 45).alias("major"), F.when(F.col("edge_id") < 8, 0).otherwise(F.col("edge_id") % 21).alias("code"))


@register("k6_dedupe_fiducials", f"""with {_F}, b as (select distinct a.image_id, a.fid from f a join f o on a.image_id = o.image_id and a.fid <> o.fid where sqrt(pow(a.cx - o.cx, 2) + pow(a.cy - o.cy, 2)) < least(a.minor, o.minor) and (o.major > a.major or (o.major = a.major and o.fid < a.fid)))
select f.* from f left join b using (image_id, fid) where b.fid is null""")
def _k6(spark, d):
    return charts.dedupe_fiducials(fids(spark, d))


_SETS = [(1, [1, 2, 3, 4]), (2, [0, 0, 5, 9]), (3, [0, 4, 8, 12]), (4, [2, 7, 11, 19])]


@register("k7_match_code_set")
def _k7(spark, d):
    return charts.match_code_set(fids(spark, d), spark.createDataFrame(_SETS, "set_id int, codes array<int>"))


@register("k8_chart_axes", f"""with {_F}, z as (select * from f where code = 0 and fid < 8), g as (select image_id, count(*) n, avg(cx) ox, avg(cy) oy, arg_max(cx, fid) - arg_min(cx, fid) dx, arg_max(cy, fid) - arg_min(cy, fid) dy from z group by 1)
select image_id, ox, oy, round(dx/sqrt(dx*dx + dy*dy), 8) tx, round(dy/sqrt(dx*dx + dy*dy), 8) ty from g where n = 2 and sqrt(dx*dx + dy*dy) > 0""")
def _k8(spark, d):
    f = fids(spark, d).withColumn("code", F.when((F.col("code") == 0) & (F.col("fid") >= 8), 21).otherwise(F.col("code")))
    return rounded(charts.chart_axes(f), "tx", "ty", digits=8)


@register("k8_chart_axes_signed", f"""with {_F}, z as (select * from f where code = 0 and fid < 8), g as (select image_id, count(*) n, avg(cx) ox, avg(cy) oy, arg_max(cx, fid) - arg_min(cx, fid) dx, arg_max(cy, fid) - arg_min(cy, fid) dy from z group by 1),
a as (select image_id, ox, oy, dx/sqrt(dx*dx + dy*dy) tx, dy/sqrt(dx*dx + dy*dy) ty from g where n = 2 and sqrt(dx*dx + dy*dy) > 0), c as (select image_id, code, max(fid) fid from f where code > 0 group by 1, 2),
o as (select image_id, i, ((image_id*3 + i*5) % 20) + 1 code from (select distinct image_id from f), (select unnest(range(0, 4)) i)),
l as (select o.image_id, i, cx, cy, row_number() over (partition by o.image_id order by i) k from o join c using (image_id, code) join f on f.image_id = o.image_id and f.fid = c.fid),
t as (select a.*, case when case when i < 2 then 1 else -1 end*((cx - ox)*tx + (cy - oy)*ty) < 0 then -1 else 1 end turn from a left join l on a.image_id = l.image_id and k = 1)
select image_id, ox, oy, round(tx*turn, 8) tx, round(ty*turn, 8) ty from t""")
def _k8_signed(spark, d):
    f = fids(spark, d).withColumn("code", F.when((F.col("code") == 0) & (F.col("fid") >= 8), 21).otherwise(F.col("code")))
    code = lambda i: ((F.col("image_id") * 3 + i * 5) % 20 + 1).cast("int")
    orders = f.select("image_id").distinct().select("image_id", F.array(*[code(i) for i in range(4)]).alias("codes"))
    return rounded(charts.chart_axes(f, orders), "tx", "ty", digits=8)


@register("k9_correspondences", f"with {_F}, l as (select cast(n_nationkey as int) code, cast(n_nationkey*5 as double) x_mm, cast(n_regionkey*7 as double) y_mm from nation where n_nationkey between 1 and 20) select image_id, fid, cx, cy, x_mm*1.5e0 x_mm, y_mm*1.5e0 y_mm from f join l using (code) where code > 0")
def _k9(spark, d):
    n = read_table(spark, d, "nation").where("n_nationkey between 1 and 20")
    layout = n.select(F.col("n_nationkey").cast("int").alias("code"), (F.col("n_nationkey") * 5).cast("double").alias("x_mm"), (F.col("n_regionkey") * 7).cast("double").alias("y_mm"))
    return charts.correspondences(fids(spark, d), layout, 1.5)


def poses(spark, d):
    """A pose for each picture: four kinds by turns."""
    rows = [(i, charts.rotation(2.0 * i, 3.0 - i, 1.0 + i), [5.0 * i, -3.0, 900.0 + 20 * i], 1000.0 + 50 * i, -0.05 + 0.01 * i, 320.0, 240.0, 900.0 + 20 * i) for i in range(4)]
    kinds = spark.createDataFrame(rows, "kind int, r array<double>, t array<double>, f double, k1 double, px double, py double, centre_depth double")
    images = view(spark, d, "v_edges").select("image_id").distinct().withColumn("kind", F.col("image_id") % 4)
    return images.join(F.broadcast(kinds), "kind").drop("kind")


def _pose_sql() -> str:
    rows = []
    for i in range(4):
        r = charts.rotation(2.0 * i, 3.0 - i, 1.0 + i)
        rows.append(f"({i}, [{', '.join(f'{v!r}::double' for v in r)}], [{5.0 * i}::double, -3.0::double, {900.0 + 20 * i}::double], {1000.0 + 50 * i}::double, {-0.05 + 0.01 * i!r}::double, 320.0::double, 240.0::double, {900.0 + 20 * i}::double)")
    return f"pk as (select * from (values {', '.join(rows)}) t(kind, r, t, f, k1, px, py, cd)), ps as (select image_id, pk.*exclude(kind) from (select distinct image_id from v_edges) join pk on kind = image_id % 4)"


_CH = f"""{_pose_sql()}, cp as (select edge_id, image_id, (ex - 320)*0.5e0 xm, (ey - 240)*0.5e0 ym, mtf, quality from v_edges),
cz as (select cp.*, ps.*exclude(image_id), r[1]*xm + r[2]*ym + t[1] c0, r[4]*xm + r[5]*ym + t[2] c1, r[7]*xm + r[8]*ym + t[3] c2 from cp join ps using (image_id)),
im2 as (select edge_id, image_id, xm, ym, mtf, quality, c2 - cd depth, f*(c0/c2)*(1 + k1*((c0/c2)*(c0/c2) + (c1/c2)*(c1/c2))) + px ix, f*(c1/c2)*(1 + k1*((c0/c2)*(c0/c2) + (c1/c2)*(c1/c2))) + py iy from cz)"""


def chart_pts(spark, d):
    return view(spark, d, "v_edges").select("edge_id", "image_id", ((F.col("ex") - 320) * 0.5).alias("x_mm"), ((F.col("ey") - 240) * 0.5).alias("y_mm"), "mtf", "quality")


@register("k10_image_to_chart", f"with {_CH} select edge_id, round(xm, 4) + 0.0e0 x_mm, round(ym, 4) + 0.0e0 y_mm from im2")
def _k10(spark, d):
    i = charts.chart_to_image(chart_pts(spark, d), poses(spark, d)).select("edge_id", "image_id", F.col("px_x").alias("ix"), F.col("px_y").alias("iy"))
    return rounded(charts.image_to_chart(i, poses(spark, d)), "x_mm", "y_mm", digits=4).select("edge_id", "x_mm", "y_mm")


@register("k11_chart_to_image", f"with {_CH} select edge_id, round(ix, 5) px_x, round(iy, 5) px_y from im2")
def _k11(spark, d):
    return rounded(charts.chart_to_image(chart_pts(spark, d), poses(spark, d)), "px_x", "px_y", digits=5).select("edge_id", "px_x", "px_y")


@register("k12_depth", f"with {_CH} select edge_id, round(depth, 6) + 0.0e0 depth from im2")
def _k12(spark, d):
    return rounded(charts.depth(chart_pts(spark, d), poses(spark, d)), "depth").select("edge_id", "depth")


@register("k13_chart_angles", f"with {_pose_sql()}, e as (select distinct image_id from v_edges) select image_id, round(degrees(atan2(r[4], r[1])), 6) + 0.0e0 roll, round(degrees(asin(-r[7])), 6) + 0.0e0 yaw, round(degrees(atan2(r[8], r[9])), 6) + 0.0e0 pitch from ps join e using (image_id)")
def _k13(spark, d):
    return rounded(charts.chart_angles(poses(spark, d).join(view(spark, d, "v_edges").select("image_id").distinct(), "image_id")), "roll", "yaw", "pitch")


@register("k14_reprojection_rmse", f"with {_CH}, e as (select image_id, sqrt(avg(pow(0.7e0*(edge_id % 5), 2))) rmse from im2 group by 1) select image_id, round(rmse, 5) rmse, rmse > 1.7 poor from e")
def _k14(spark, d):
    c = charts.chart_to_image(chart_pts(spark, d), poses(spark, d)).select("image_id", "x_mm", "y_mm", (F.col("px_x") + 0.7 * (F.col("edge_id") % 5)).alias("cx"), F.col("px_y").alias("cy"))
    return rounded(charts.reprojection_rmse(c, poses(spark, d), 1.7), "rmse", digits=5)


@register("k16_focus_samples", f"with {_CH} select image_id, round(depth, 6) + 0.0e0 depth, round(mtf, 9) mtf, quality from im2 where quality > 0.2 and abs(xm) <= 80 and abs(ym) <= 100")
def _k16(spark, d):
    return rounded(rounded(charts.focus_samples(chart_pts(spark, d), poses(spark, d), 80.0, 100.0), "depth"), "mtf", digits=9)


_W9 = " + ".join(f"{w!r}::double*{'v' if k == 0 else ('lag' if k < 0 else 'lead') + f'(v, {abs(k)}) over w9'}" for w, k in zip(charts.SG9, range(-4, 5)))


@register("k17_sg_outliers", f"with s as (select *, {_W9} s from v_events window w9 as (partition by edge_id order by i, v)) select edge_id, i, v from s where s is null or abs(v - s) <= 0.5e0*abs(s)")
def _k17(spark, d):
    return charts.sg_outliers(view(spark, d, "v_events"), ["edge_id"], "i", "v", 0.5)


@register("k20_curve_peak", """with c as (select edge_id, x, 100.0e0 - edge_id*0.1e0 - pow(x - (edge_id % 50)*0.37e0, 2) y from v_edges, (select unnest(range(-10, 40)) x)), n as (select *, lag(y) over w yl, lead(y) over w yr from c window w as (partition by edge_id order by x)),
r as (select *, row_number() over (partition by edge_id order by y desc, x) k from n) select edge_id, round(x + coalesce(case when yl - 2*y + yr < 0 then (yl - yr)/(2*(yl - 2*y + yr)) else 0 end, 0), 6) + 0.0e0 peak, round(y, 6) top from r where k = 1""")
def _k20(spark, d):
    e = view(spark, d, "v_edges").withColumn("x", F.explode(F.sequence(F.lit(-10), F.lit(39))))
    c = e.withColumn("y", 100.0 - F.col("edge_id") * 0.1 - F.pow(F.col("x") - (F.col("edge_id") % 50) * 0.37, 2.0))
    return rounded(charts.curve_peak(c, ["edge_id"], "x", "y"), "peak", "top")


@register("k21_bootstrap_peak")
def _k21(spark, d):
    e = view(spark, d, "v_events").select((F.col("edge_id") % 20).alias("edge_id"), (F.col("i") % 40).alias("x"), (F.col("v") - 0.05 * F.pow(F.col("i") % 40 - 18.0, 2.0)).alias("y"))
    return rounded(focus.bootstrap_peak(e, ["edge_id"], "x", "y"), "low", "high", digits=4)


@register("s17_camera_properties", """select c_custkey, round(case c_custkey % 4 when 0 then (35 + c_custkey % 9)/36.0e0 when 1 then 50/sqrt(43.3e0*43.3e0/(1 + 1/pow(3.0e0/2, 2))) when 2 then 50/(25.4e0*(4000 + c_custkey % 7)/3000) else -1 end, 8) focal_ratio from customer""")
def _s17(spark, d):
    c = read_table(spark, d, "customer")
    k = F.col("c_custkey")
    empty = F.create_map().cast("map<string,string>")
    props = F.when(k % 4 == 0, F.create_map(F.lit("focal35"), (35 + k % 9).cast("string"))).when(k % 4 == 1, F.create_map(*[F.lit(x) for x in ("focal", "50", "diagonal", "43.3", "aspect", "3:2")])).when(k % 4 == 2, F.create_map(F.lit("focal"), F.lit("50"), F.lit("pixels"), (4000 + k % 7).cast("string"), F.lit("resolution"), F.lit("3000"))).otherwise(empty)
    return rounded(charts.focal_ratio(c.select("c_custkey", props.alias("props"))), "focal_ratio", digits=8).select("c_custkey", "focal_ratio")


def _contours(spark, d):
    """Contours of the dark objects of the rasters, with gradients."""
    from acutance.operators import geometry, raster
    from acutance.plans import shapes

    b = geometry.boundaries(shapes.comps(spark, d))
    return b.join(raster.gradients(px(spark, d)), ["image_id", "y", "x"])


_EL = """el as (select edge_id fid, image_id, ex cx, ey cy, 10 + edge_id % 7 major, 6 + edge_id % 5 minor, radians(angle) a from v_edges)"""


def ellipses(spark, d):
    e = view(spark, d, "v_edges")
    return e.select("image_id", F.col("edge_id").alias("fid"), F.col("ex").alias("cx"), F.col("ey").alias("cy"), (10 + F.col("edge_id") % 7).alias("major"), (6 + F.col("edge_id") % 5).alias("minor"), F.radians("angle").alias("angle"))


def ellipse_points(spark, d):
    """40 points on each ellipse, with the gradient along the normal, turned a little at every fifth."""
    e = ellipses(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39))))
    t = F.col("i") * (3.141592653589793 / 20)
    u, v, c, s = F.col("major") * F.cos(t), F.col("minor") * F.sin(t), F.cos("angle"), F.sin("angle")
    nu, nv = F.cos(t) / F.col("major"), F.sin(t) / F.col("minor")
    return e.select("image_id", "fid", (F.col("cx") + u * c - v * s).alias("x"), (F.col("cy") + u * s + v * c).alias("y"), (nu * c - nv * s).alias("gx"), (nu * s + nv * c).alias("gy"), F.lit(1.0).alias("w"))


@register("k1_ellipse_precheck")
def _k1(spark, d):
    from acutance.plans.rasters import images

    return rounded(charts.ellipse_precheck(_contours(spark, d).select("image_id", "label", "y", "x"), images(spark, d).drop("top")), "cx", "cy", "major", "minor")


@register("k2_fit_ellipse", "select image_id, edge_id fid, round(ex, 4) + 0.0e0 cx, round(ey, 4) + 0.0e0 cy, round(greatest(10 + edge_id % 7, 6 + edge_id % 5), 4)::double major, round(least(10 + edge_id % 7, 6 + edge_id % 5), 4)::double minor from v_edges")
def _k2(spark, d):
    """Points on known ellipses: the fit gives them back."""
    return rounded(charts.fit_ellipse(ellipse_points(spark, d), ["image_id", "fid"]), "cx", "cy", "major", "minor", digits=4)


@register("k3_ellipse_gradient_check", "select image_id, edge_id fid, 0.0e0 off, true ok from v_edges")
def _k3(spark, d):
    e = ellipses(spark, d)
    out = charts.ellipse_gradient_check(ellipse_points(spark, d), e, ["image_id", "fid"])
    return rounded(out, "off", digits=3)


@register("k4_decode_fiducial")
def _k4(spark, d):
    e = px(spark, d).where("y % 12 = 8 and x % 10 = 7").select("image_id", (F.col("y") * 100 + F.col("x")).alias("fid"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), F.lit(5.0).alias("major"), F.lit(4.0).alias("minor"), F.lit(0.3).alias("angle"))
    return charts.decode_fiducial(px(spark, d), e)


@register("k5_hole_near_centre", f"""with recursive {_CC}, ct as (select image_id, label own, avg(x) cx, avg(y) cy from cp group by 1, 2),
o as (select image_id, own, cast(round_even(cy + dy, 0) as int) y, cast(round_even(cx + dx, 0) as int) x from ct, unnest(range(-3, 4)) a(dy), unnest(range(-3, 4)) b(dx))
select image_id, own as label, coalesce(bool_or(cp.label <> own), false) hole from o left join cp using (image_id, y, x) group by 1, 2""")
def _k5(spark, d):
    from acutance.operators import geometry
    from acutance.plans import shapes

    c = shapes.comps(spark, d)
    return charts.hole_near_centre(c, geometry.component_centroid(c))


@register("k15_largest_block_scale", """with b as (select image_id, edge_id block_id, ex cx, 100.0e0 + (edge_id*7919 % 1000) area from v_edges), r as (select *, row_number() over (partition by image_id order by area desc, block_id) k, lead(area) over (partition by image_id order by area desc, block_id) nx, percent_rank() over (partition by image_id order by cx, block_id) side from b)
select image_id, block_id, round(62/sqrt(area), 9) mm_per_px, round(side, 9) side, nx is null or area >= 1.01e0*nx dominant from r where k = 1""")
def _k15(spark, d):
    b = view(spark, d, "v_edges").select("image_id", F.col("edge_id").alias("block_id"), F.col("ex").alias("cx"), (100.0 + F.col("edge_id") * 7919 % 1000).alias("area"))
    return rounded(charts.largest_block_scale(b, ratio=1.01), "mm_per_px", "side", digits=9)


def _focus(spark, d):
    s = view(spark, d, "v_samples").withColumn("y_mm", F.col("par") - 100)
    at = 0.0005 * F.col("y_mm") ** 2 + F.col("edge_id") % 5
    return s.select((F.col("edge_id") % 5).alias("image_id"), "y_mm", F.col("perp").alias("depth"), (0.5 - 0.0004 * (F.col("perp") - at) ** 2).alias("mtf"))


_LINES = [float(v) for v in range(-60, 61, 20)]


@register("k22_focus_ridge", f"""with p as (select edge_id % 5 image_id, par - 100 ym, perp x, 0.5e0 - 0.0004e0*pow(perp - (0.0005e0*pow(par - 100, 2) + edge_id % 5), 2) y from v_samples),
n as (select image_id, l line, exp(-pow(ym - l, 2)/18) w, x, y from p, (select unnest({_LINES}::double[]) l) where abs(ym - l) < 15),
s as (select image_id, line, count(*) n, sum(w) s0, sum(w*x) s1, sum(w*x*x) s2, sum(w*x*x*x) s3, sum(w*x*x*x*x) s4, sum(w*y) t0, sum(w*x*y) t1, sum(w*x*x*y) t2 from n group by 1, 2 having count(*) >= 42),
d as (select *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) det from s), f as (select image_id, line, n, (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0))/det a, (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - s2*t1))/det b from d)
select image_id, line, round(-b/(2*a), 3) + 0.0e0 peak, n from f where a < 0""")
def _k22(spark, d):
    return rounded(charts.focus_ridge(_focus(spark, d), ["image_id"], _LINES), "peak", digits=3)


#: Lines on both sides of the chart's centre, 4 mm apart.
_RIDGE = [float(side * v) for side in (-1, 1) for v in range(10, 91, 4)]


@register("k22_focus_lines")
def _k22_lines(spark, d):
    return rounded(focus.focus_lines(_focus(spark, d), ["image_id"], _RIDGE), "y", "peak", digits=3)


@register("k23_focus_curve")
def _k23(spark, d):
    """The best focus on the chart's axis and 40 mm to both sides, with bounds."""
    from acutance.session import materialise

    ridge = materialise(focus.focus_lines(_focus(spark, d), ["image_id"], _RIDGE), "focus-ridge")
    at = [-40.0, 0.0, 40.0]
    curve = focus.focus_curve(ridge, ["image_id"], at=at)
    return rounded(curve.join(focus.focus_bounds(ridge, ["image_id"], at=at), ["image_id", "y"]), "peak", "low", "high", digits=2)


@register("k24_bayer_focus")
def _k24(spark, d):
    """The ridge of each channel: the channel is one more key."""
    s = _focus(spark, d).withColumn("channel", F.floor(F.col("depth") * 8).cast("int") % 3)
    return rounded(focus.focus_lines(s, ["image_id", "channel"], _RIDGE, least=20), "y", "peak", digits=3)


@register("l13_two_pass")
def _l13(spark, d):
    """Fit each image's bent ridges, correct them, and measure their straightness before and after."""
    from acutance.session import materialise

    r = materialise(ridge(spark, d), "ridges")
    fit = lens.fit_distortion(r, ["ridge_id"], ["image_id"], rounds=7).select("image_id", F.lit(1).alias("cand"), "k1", "k2")
    cand = fit.unionByName(fit.select("image_id", F.lit(0).alias("cand"), F.lit(0.0).alias("k1"), F.lit(0.0).alias("k2")))
    return rounded(lens.straightness(r, cand, ["ridge_id"], ["image_id"]).join(cand, ["cand", "image_id"]), "cost", digits=12)


@register("s16_write_correspondence", f"with {_F}, l as (select cast(n_nationkey as int) code, cast(n_nationkey*5 as double) x_mm, cast(n_regionkey*7 as double) y_mm from nation where n_nationkey between 1 and 20) select cx img_x, cy img_y, x_mm chart_x, y_mm chart_y from f join l using (code) where code > 0")
def _s16(spark, d):
    from acutance.session import shared_path

    path = shared_path(spark, "correspondence")
    k9 = _k9(spark, d)
    k9.select(F.col("cx").alias("img_x"), F.col("cy").alias("img_y"), (F.col("x_mm") / 1.5).alias("chart_x"), (F.col("y_mm") / 1.5).alias("chart_y")).write.option("header", True).csv(path)
    return spark.read.schema("img_x double, img_y double, chart_x double, chart_y double").option("header", True).csv(path)
