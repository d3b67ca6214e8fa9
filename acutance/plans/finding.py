"""Queries of target finding, robust lines, holes and grouped fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from acutance.operators import esf, geometry, reports, targets
from acutance.plans import shapes
from acutance.plans.curves import LSF, padded, rounded
from acutance.plans.rasters import IMAGES, images, px
from acutance.plans.registry import register, view
from acutance.plans.shapes import _BLOCK, _CC, _DIR, _SL, EK

_Q2 = f"""{_DIR}, s as (select *, n*72 + bin sc from h), b as (select a.image_id, a.bin, a.n, a.sc, max(o.sc) best from s a join s o on a.image_id = o.image_id and (o.bin - a.bin + 144) % 72 in (69, 70, 71, 0, 1, 2) group by 1, 2, 3, 4),
pk as (select * from (select image_id, bin, cast(row_number() over (partition by image_id order by sc desc) as int) rank from b where sc = best) where rank <= 4)"""


@register("q3_refine_peaks", f"""with {_Q2}, o as (select g.image_id, rank, bin*2*pi()/72 - pi() at0, ((atan2(gy, gx) - (bin*2*pi()/72 - pi()) + pi()) % (2*pi()) + 2*pi()) % (2*pi()) - pi() off from g join pk using (image_id) where gx <> 0 or gy <> 0),
r as (select *, row_number() over (partition by image_id, rank order by off) - 1 i, count(*) over (partition by image_id, rank) n from o where abs(off) <= 0.06*pi())
select image_id, rank, round(at0 + avg(off), 5) theta, count(*) n from r where i >= floor(n*0.05) and i < n - floor(n*0.05) group by image_id, rank, at0""")
def _q3(spark, d):
    dirs = shapes.directions(spark, d)
    peaks = geometry.circular_peaks(geometry.angle_histogram(dirs, ["image_id"]), ["image_id"])
    return rounded(targets.refine_peaks(dirs.select("image_id", "theta"), peaks, ["image_id"]), "theta", digits=5)


#: Points round each block: 40 places on its circle with the direction of their tangent.
_PTS = f"{_BLOCK}, bp as (select block_id, cast(i as int) i, ex + r*cos(i*pi()/20) x, ey + r*sin(i*pi()/20) y, i*pi()/20 + pi()/2 theta from bl, (select unnest(range(0, 40)) i))"


def block_points(spark, d):
    b = view(spark, d, "v_edges").select(F.col("edge_id").alias("block_id"), "ex", "ey", (8 + F.col("edge_id") % 9).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    u = F.col("i") * (math.pi / 20)
    return b.select("block_id", (F.col("ex") + F.col("r") * F.cos(u)).alias("x"), (F.col("ey") + F.col("r") * F.sin(u)).alias("y"), (u + math.pi / 2).alias("theta"))


_ASG = f"""{_PTS}, aj as (select bp.block_id, bp.i, x, y, k, round(abs((y - cy)*cos(angle) - (x - cx)*sin(angle)), 6) d, abs(cos(theta - angle)) >= cos(radians(20)) ag from bp join ed using (block_id)),
asg as (select * from (select *, row_number() over (partition by block_id, i order by d, k, ag) n from aj) where n = 1)"""


@register("q4_assign_to_edges", f"with {_ASG} select block_id, k, count(*) n, round(sum(d), 2) total, count(*) filter (ag) agree from asg group by 1, 2")
def _q4(spark, d):
    a = targets.assign_to_edges(block_points(spark, d), shapes.blocks(spark, d), ["block_id"])
    return rounded(a.groupBy("block_id", "k").agg(F.count("*").alias("n"), F.sum("distance").alias("total"), F.count_if("agrees").alias("agree")), "total", digits=2)


@register("q7_quad_validity", f"""with {_ASG}, s as (select block_id, count(*) filter (not ag)/cast(count(*) as double) outliers, count(*) filter (d > 2)/cast(count(*) as double) mild, count(*) filter (d > 4.2)/cast(count(*) as double) severe from asg group by 1)
select block_id, round(outliers, 9) outliers, round(mild, 9) mild, round(severe, 9) severe, outliers <= 0.125 and mild <= 0.1 and severe <= 0.02 valid from s""")
def _q7(spark, d):
    a = targets.assign_to_edges(block_points(spark, d), shapes.blocks(spark, d), ["block_id"])
    return rounded(targets.quad_validity(a, ["block_id"], 2.0, 4.2), "outliers", "mild", "severe", digits=9)


@register("q10_edge_roi_boxes", f"with {_BLOCK}, e as (select block_id, k, r*4.0e0 len, least(16, greatest(5, 0.08e0*r*4)) s from ed) select block_id, k, round(s - len/2, 6) along0, round(len/2 - s, 6) along1, -28.5e0 across0, 28.5e0 across1 from e where s < len/2")
def _q10(spark, d):
    return rounded(targets.edge_roi_boxes(shapes.blocks(spark, d).withColumn("length", F.col("r") * 4.0), ["block_id"]), "along0", "along1")


@register("q12_homogeneous", f"""with recursive {_CC}, ob as (select image_id, label, avg(x) cx, avg(y) cy from cp group by 1, 2), oe as (select ob.*, k, round(cos(k*pi()/2), 12) nx, round(sin(k*pi()/2), 12) ny from ob, (select unnest(range(0, 4)) k)),
op as (select image_id, label, k, cast(round_even(cy + i*ny, 0) as int) y, cast(round_even(cx + i*nx, 0) as int) x from oe, (select unnest(range(1, 9)) i)),
oh as (select op.image_id, op.label, k, count(cp.y) n from op left join cp on op.image_id = cp.image_id and op.label = cp.label and op.y = cp.y and op.x = cp.x group by 1, 2, 3)
select image_id, label, bool_and(n >= 3) homogeneous from oh group by 1, 2""")
def _q12(spark, d):
    c = shapes.comps(spark, d)
    e = c.groupBy("image_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    e = e.withColumns({"nx": F.round(F.cos(F.col("k") * math.pi / 2), 12), "ny": F.round(F.sin(F.col("k") * math.pi / 2), 12)})
    return targets.homogeneous(e, c, ["image_id", "label"], 8, 3)


_REF = f"""{_SL}, rp as (select image_id, edge_id, perp, par, cast(v as double) w from sm), rh as (select image_id, edge_id, cast(floor(perp*8) as int) + d bin, sum(w) w from rp, (select unnest(range(-3, 4)) d) group by 1, 2, 3),
rs as (select *, sum(w) over (partition by image_id, edge_id order by bin)/sum(w) over (partition by image_id, edge_id) sh from rh), rl as (select image_id, edge_id, max(case when round(sh, 9) <= 0.1 then bin end) lo, min(case when round(sh, 9) >= 0.9 then bin end) hi from rs group by 1, 2),
rt as (select rp.* from rp join rl using (image_id, edge_id) where floor(perp*8) between coalesce(lo, -1000000) and coalesce(hi, 1000000)), rn2 as (select image_id, edge_id, max(w) top from rt group by 1, 2 having count(*) >= 20),
rw as (select image_id, edge_id, par x, perp y, pow(w/top, 4)/(10 + abs(perp)) w from rt join rn2 using (image_id, edge_id)),
rm2 as (select image_id, edge_id, sum(w) s0, sum(w*x)/sum(w) cx, sum(w*y)/sum(w) cy, sum(w*x*x)/sum(w) xx, sum(w*x*y)/sum(w) xy, sum(w*y*y)/sum(w) yy from rw group by 1, 2)"""


@register("q13_edge_refine", f"with {_REF} select image_id, edge_id, round(cx, 5) cx, round(cy, 5) cy, round(atan2(2*(xy - cx*cy), xx - cx*cx - yy + cy*cy)/2, 5) + 0.0e0 angle from rm2")
def _q13(spark, d):
    out = targets.edge_refine(shapes.sampled(spark, d).withColumn("w", F.col("v").cast("double")), EK)
    return rounded(out.select(*EK, "cx", "cy", "angle"), "cx", "cy", "angle", digits=5)


@register("q21_ridge", f"""with {_SL}, tp as (select image_id, edge_id, max(v) top from sm group by 1, 2), rg as (select sm.image_id, sm.edge_id, cast(round_even(round(par, 6), 0) as int) seq, count(*) n, sum(pow(v/cast(top as double), 4)*perp) a, sum(pow(v/cast(top as double), 4)) b from sm join tp using (image_id, edge_id) group by 1, 2, 3 having count(*) > 4)
select image_id, edge_id, seq, round(sum(a) over w/sum(b) over w, 5) + 0.0e0 perp from rg window w as (partition by image_id, edge_id order by seq rows between 2 preceding and 2 following)""")
def _q21(spark, d):
    p = shapes.sampled(spark, d).withColumn("par", F.round("par", 6)).withColumn("w", F.col("v").cast("double"))
    return rounded(targets.ridge(p, EK, 4), "perp", digits=5)


@register("h7_robust_line", """with pt as (select image_id, x, min(y) y from v_pixels where v < 33000 group by 1, 2), ln as (select a.image_id, a.x x1, b.x x2, (b.y - a.y)/cast(b.x - a.x as double) m, a.y - (b.y - a.y)/cast(b.x - a.x as double)*a.x c from pt a join pt b on a.image_id = b.image_id and a.x < b.x),
er as (select ln.image_id, x1, x2, pt.x, pt.y, pt.y - m*pt.x - c e from ln join pt using (image_id) where abs(pt.y - m*pt.x - c) <= 1.5),
st as (select image_id, x1, x2, count(*) n, avg(e*e) ms, avg(x) ax, avg(y) ay, avg(cast(x as double)*x) axx, avg(cast(x as double)*y) axy from er group by 1, 2, 3), bs as (select *, row_number() over (partition by image_id order by n desc, round(ms, 9), x1, x2) k from st)
select image_id, n inliers, round((axy - ax*ay)/(axx - ax*ax), 6) + 0.0e0 slope, round(ay - (axy - ax*ay)/(axx - ax*ax)*ax, 6) "offset" from bs where k = 1""")
def _h7(spark, d):
    pts = px(spark, d).where("v < 33000").groupBy("image_id", "x").agg(F.min("y").alias("y"))
    return rounded(targets.robust_line(pts, ["image_id"], 1.5), "slope", "offset")


@register("h8_fill_bars", f"with {IMAGES} select p.image_id, y, x, case when y between 3 + p.image_id and 40 then v else top end v from v_pixels p join im using (image_id)")
def _h8(spark, d):
    b = images(spark, d).select("image_id", (F.col("image_id") + 3).alias("y0"), F.lit(40).alias("y1"), F.col("top").alias("fill"))
    return targets.fill_bars(px(spark, d), b)


@register("c5_largest_hole")
def _c5(spark, d):
    """SQL would need a second recursive labelling; the tests hold it against planted rings."""
    p = px(spark, d)
    wide = p.where("v < 38000").select("image_id", "y", "x")
    comps = geometry.component_pixels(geometry.connected_components(geometry.runs(wide)))
    return targets.largest_hole(comps, p, images(spark, d).drop("top"))


def _centroid_sql(rounds: int) -> str:
    out = ["c0 as (select edge_id, sum(a*h*bin)/sum(a*h) c, 256.0e0 s2 from (select edge_id, bin, abs(v) a, 0.5e0 - 0.5e0*cos(2*pi()*bin/512) h from l) group by 1)"]
    for i in range(rounds):
        out.append(f"w{i} as (select l.edge_id, bin, abs(v)*exp(-(bin - c)*(bin - c)/(2*s2)) g from l join c{i} using (edge_id)), t{i} as (select edge_id, sum(g) t, sum(g*bin)/sum(g) c from w{i} group by 1), c{i + 1} as (select edge_id, any_value(c) c, greatest(1.0e0, least(256.0e0, sum(g*(bin - c)*(bin - c))/any_value(t))) s2 from w{i} join t{i} using (edge_id) group by 1)")
    return ", ".join(out) + f" select edge_id, round((c - 256)/8, 5) + 0.0e0 centroid from c{rounds}"


@register("r24_gaussian_centroid", LSF + ", " + _centroid_sql(11))
def _r24(spark, d):
    return rounded(targets.gaussian_centroid(esf.lsf(padded(spark, d), ["edge_id"]), ["edge_id"]), "centroid", digits=5)


@register("b12_esf_loess")
def _b12(spark, d):
    return rounded(targets.esf_loess(view(spark, d, "v_samples"), ["edge_id"]), "v", digits=3)


@register("b12_loess_zones")
def _b12_zones(spark, d):
    s = view(spark, d, "v_samples")
    width = esf.transition_width(padded(spark, d), ["edge_id"])
    about = width.join(esf.snr_ratios(esf.snr(s, padded(spark, d), ["edge_id"])), "edge_id").select("edge_id", "half_width", F.col("mean_cnr").alias("cnr"))
    return rounded(targets.esf_loess_zones(s, about, ["edge_id"]), "v", digits=3)


@register("k18_rational_fit")
def _k18(spark, d):
    s = view(spark, d, "v_samples").select(F.col("edge_id"), F.col("perp").alias("x"), (1 / (1 + F.pow((F.col("perp") - F.col("edge_id") % 20 * 0.2) / 20, 2.0)) + F.col("v") * 1e-9).alias("y"))
    return rounded(targets.rational_fit(s, ["edge_id"], "x", "y"), "peak", "value", digits=4)


@register("r6_surface_fit")
def _r6(spark, d):
    m = reports.classify_ms(view(spark, d, "v_edges"), 320, 240)
    cells = reports.grid_composite(m, 24.0)
    return rounded(targets.surface_fit(cells.select("image_id", "direction", "gy", "gx", "v"), ["image_id", "direction"], rows=21, columns=28), "v", digits=6).drop("far")


@register("r8_surface_eval")
def _r8(spark, d):
    k = ["image_id", "direction"]
    cells = reports.grid_composite(reports.classify_ms(view(spark, d, "v_edges"), 320, 240), 24.0).select(*k, "gy", "gx", "v")
    return rounded(targets.surface_eval(targets.surface_fit(cells, k, rows=21, columns=28), k, 2, 1, 0.0, 1.0), "v")


@register("k19_irls_refit")
def _k19(spark, d):
    """The rational curve again with two in a hundred samples spoilt: the refit leaves them out."""
    spoilt = F.when(F.col("edge_id") * 7 % 50 + F.floor(F.abs(F.col("perp")) * 8) % 50 == 1, 1.3).otherwise(1.0)
    y = spoilt / (1 + F.pow((F.col("perp") - F.col("edge_id") % 20 * 0.2) / 20, 2.0))
    s = view(spark, d, "v_samples").select("edge_id", F.col("perp").alias("x"), y.alias("y"))
    return rounded(targets.rational_fit(s, ["edge_id"], "x", "y"), "peak", "value", digits=4)
