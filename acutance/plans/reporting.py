"""Queries of the reports over edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from acutance.operators import esf, reports
from acutance.plans.curves import SFR, rounded, sfr
from acutance.plans.registry import register, view
from acutance.session import read_table


def edges(spark, d):
    return view(spark, d, "v_edges")


def _pick(src: str, keys: str, value: str, q: str) -> str:
    """SQL of the order statistic at floor(n q)."""
    return f"select {keys}, {q} q, {value} as value, n from (select *, row_number() over (partition by {keys} order by {value}) - 1 k, count(*) over (partition by {keys}) n from {src}) where k = least(floor(n*{q}), n - 1)"


_R1 = "with e as (select image_id, 'all' population, mtf from v_edges where mtf <> 1 union all select image_id, 'good', mtf from v_edges where mtf <> 1 and quality >= 0.5), "


@register("r1_quantile_stats", _R1 + "r as (" + " union all ".join(_pick("e", "image_id, population", "mtf", f"{q}::double") for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ") select image_id, population, q, round(value, 9) as value, n from r")
def _r1(spark, d):
    return rounded(reports.quantile_stats(edges(spark, d)), "value", digits=9)


_COS = "abs(dx*cos(radians(angle)) + dy*sin(radians(angle)))/greatest(sqrt(dx*dx + dy*dy), 1e-9)"


@register("r2_radial_angle", f"with e as (select *, ex - avg(ex) over (partition by image_id) dx, ey - avg(ey) over (partition by image_id) dy from v_edges) select edge_id, round(degrees(acos(least(1.0e0, {_COS}))), 4) radial_angle from e")
def _r2(spark, d):
    return rounded(reports.radial_angle(edges(spark, d)), "radial_angle", digits=4).select("edge_id", "radial_angle")


_MS = f"""e as (select *, ex - 320 dx, ey - 240 dy from v_edges), c as (select *, {_COS} c from e),
ms as (select *, case when c > cos(radians(45)) then 'meridional' else 'sagittal' end direction from c)"""


@register("r3_classify_ms", f"with {_MS} select edge_id, direction from ms")
def _r3(spark, d):
    return reports.classify_ms(edges(spark, d), 320, 240).select("edge_id", "direction")


_R4 = f"""{_MS}, r as (select image_id, direction, cast(round_even(ey/80, 0) as int) gy, cast(round_even(ex/80, 0) as int) gx, mtf,
  row_number() over (partition by image_id, direction, round_even(ey/80, 0), round_even(ex/80, 0) order by abs(mtf) desc, mtf desc) k from ms), cells as (select image_id, direction, gy, gx, mtf v from r where k = 1)"""


@register("r4_grid_composite", f"with {_R4} select image_id, direction, gy, gx, round(v, 9) v from cells")
def _r4(spark, d):
    return rounded(reports.grid_composite(reports.classify_ms(edges(spark, d), 320, 240), 80.0), "v", digits=9)


@register("r5_percentile_bounds", f"with lo as ({_pick('v_edges', 'image_id', 'mtf', '0.05::double')}), hi as ({_pick('v_edges', 'image_id', 'mtf', '0.97::double')}) select image_id, round(lo.value, 9) low, round(hi.value, 9) high from lo join hi using (image_id) where lo.n >= 20")
def _r5(spark, d):
    return rounded(reports.percentile_bounds(edges(spark, d)), "low", "high", digits=9)


def _cells(spark, d):
    return reports.grid_composite(reports.classify_ms(edges(spark, d), 320, 240), 80.0).groupBy("image_id", "gy", "gx").agg(F.max("v").alias("v"))


_CELL = f"{_R4}, one as (select image_id, gy, gx, max(v) v from cells group by 1, 2, 3)"


@register("r7_fill_empty_knots", f"""with {_CELL}, g as (select image_id, cast(a as int) gy, cast(b as int) gx from (select distinct image_id from one), (select unnest(range(0, 7)) a), (select unnest(range(0, 9)) b)),
r7 as (select g.*, one.v, abs(g.gy - one.gy) + abs(g.gx - one.gx) dist, row_number() over (partition by g.image_id, g.gy, g.gx order by abs(g.gy - one.gy) + abs(g.gx - one.gx), v desc) k from g join one using (image_id))
select image_id, gy, gx, round(v, 9) v, dist as distance from r7 where k = 1""")
def _r7(spark, d):
    return rounded(reports.fill_empty_knots(_cells(spark, d), 7, 9), "v", digits=9)


@register("r9_bilinear_upsample", f"""with {_CELL}, f as (select image_id, gy, gx, sy, sx, gy*4 + sy fy, gx*4 + sx fx from one, (select unnest(range(0, 4)) sy), (select unnest(range(0, 4)) sx)),
c9 as (select f.image_id, fy, fx, f.gy + a gy, f.gx + b gx, (case when a = 1 then sy/4.0e0 else 1 - sy/4.0e0 end)*(case when b = 1 then sx/4.0e0 else 1 - sx/4.0e0 end) w from f, (select unnest([0, 1]) a), (select unnest([0, 1]) b))
select c9.image_id, cast(fy as int) fy, cast(fx as int) fx, round(sum(w*v)/sum(w), 8) v from c9 join one on c9.image_id = one.image_id and c9.gy = one.gy and c9.gx = one.gx where w > 0 group by 1, 2, 3""")
def _r9(spark, d):
    return rounded(reports.bilinear_upsample(_cells(spark, d), 4), "v", digits=8)


_R11 = f"""e as (select *, ex - 320 dx, ey - 240 dy from v_edges where mtf < 1 and quality > 0.3), c as (select *, {_COS} c from e),
prof as (select image_id, edge_id, case when c > cos(radians(15)) then 'meridional' else 'sagittal' end direction, sqrt(dx*dx + dy*dy) radius, mtf from c where c > cos(radians(15)) or c <= cos(radians(75)))"""


@register("r11_lens_profile", f"with {_R11} select image_id, edge_id, direction, round(radius, 6) radius, round(mtf, 9) mtf from prof")
def _r11(spark, d):
    return rounded(rounded(reports.lens_profile(edges(spark, d), 320, 240), "radius"), "mtf", digits=9)


_R11_AT = " union all ".join(f"select edge_id, {f}e0 freq, max(m) filter (k = {int(f * 64)}) + (max(m) filter (k = {int(f * 64) + 1}) - max(m) filter (k = {int(f * 64)}))*{f * 64 - int(f * 64)!r}e0 contrast from s group by 1" for f in (0.05, 0.1, 0.2))


def _profile(spark, d):
    e = edges(spark, d)
    m = sfr(spark, d).withColumnRenamed("edge_id", "e20").join(e.select("image_id", "edge_id", (F.col("edge_id") % 20).alias("e20")), "e20")
    return reports.profile_points(e, m, ["image_id", "edge_id"], 320, 240, [0.05, 0.1, 0.2])


@register("r11_profile_points", SFR + f", {_R11}, ct as ({_R11_AT}) select image_id, direction, freq, round(radius, 6) radius, round(contrast, 6) + 0.0e0 contrast from prof join ct on ct.edge_id = prof.edge_id % 20")
def _r11_points(spark, d):
    return rounded(_profile(spark, d), "radius", "contrast")


@register("r13_profile_curve")
def _r13_curve(spark, d):
    """The curves of R11's points of all captures, by local polynomials."""
    return rounded(reports.local_poly(_profile(spark, d), ["direction", "freq"], "radius", "contrast", sparse=True), "x", "y", digits=5)


@register("r13_local_poly", """with p as (select image_id, sqrt(pow(ex - 320, 2) + pow(ey - 240, 2)) r, mtf from v_edges),
n as (select image_id, i, r - i*400.0e0/63 u, pow(1 - pow(abs(r - i*400.0e0/63)/80, 3), 3) w, mtf from p, (select unnest(range(0, 64)) i) where abs(r - i*400.0e0/63) < 80),
s as (select image_id, i, count(*) n, sum(w) s0, sum(w*u) s1, sum(w*u*u) s2, sum(w*mtf) t0, sum(w*u*mtf) t1 from n where w > 0 group by 1, 2)
select image_id, round(i*400.0e0/63, 6) x, round(case when s0*s2 - s1*s1 > 1e-9 then (t0*s2 - t1*s1)/(s0*s2 - s1*s1) else t0/s0 end, 5) y from s where n >= 3""")
def _r13(spark, d):
    p = edges(spark, d).withColumn("r", F.sqrt((F.col("ex") - 320) ** 2 + (F.col("ey") - 240) ** 2))
    return rounded(rounded(reports.local_linear(p, ["image_id"], "r", "mtf", 64, 0.0, 400.0, 80.0), "x"), "y", digits=5)


_RM = "rm as (select image_id, cast(round_even(ey, 0) as int) as pos, max(mtf) mtf from v_edges where (angle % 180 <= 30 or angle % 180 >= 150) and quality >= 0.5 group by 1, 2)"


@register("r16_row_maxima", f'with {_RM} select image_id, pos as "at", round(mtf, 9) mtf from rm')
def _r16(spark, d):
    return rounded(reports.row_maxima(edges(spark, d)), "mtf", digits=9)


@register("r18_median5", "with w as (select edge_id, i, list_sort(list(v) over (partition by edge_id order by i rows between 2 preceding and 2 following)) a from v_events) select edge_id, i, a[len(a)//2 + 1] v from w")
def _r18(spark, d):
    return reports.median5(view(spark, d, "v_events"), ["edge_id"], "i", "v")


@register("r20_robust_max", f"with {_RM}, t as ({_pick('rm', 'image_id', 'mtf', '0.98::double')}) select image_id, round(value/0.9e0, 9) robust_max from t")
def _r20(spark, d):
    return rounded(reports.robust_max(reports.row_maxima(edges(spark, d)), ["image_id"]), "robust_max", digits=9)


@register("r21_profile_peak", """with t as (select *, row_number() over (partition by image_id order by mtf desc, edge_id desc) k from v_edges), r as (select * from t where k > 1),
c as (select image_id, avg(ex) cx, avg(ey) cy from r group by 1), d as (select r.image_id, edge_id, mtf, round(sqrt(pow(ex - cx, 2) + pow(ey - cy, 2)), 6) d from r join c using (image_id)),
b as (select *, row_number() over (partition by image_id order by d, edge_id) n from d) select image_id, edge_id, d distance, round(mtf, 9) mtf from b where n = 1""")
def _r21(spark, d):
    return rounded(reports.profile_peak(edges(spark, d)), "mtf", digits=9)


@register("r21_reference_edge", """with e as (select *, edge_id // 16 block_id from v_edges), a as (select image_id, block_id, (max(ex) - min(ex))*(max(ey) - min(ey)) area, avg(ex) x, avg(ey) y from e group by 1, 2),
t as (select *, row_number() over (partition by image_id order by area desc, block_id) k from a), mid as (select image_id, avg(x) mx, avg(y) my from t where k > 1 group by 1),
o as (select e.*, row_number() over (partition by e.image_id order by coalesce(round(sqrt(pow(ex - mx, 2) + pow(ey - my, 2)), 6), 0), edge_id) n from e join t on t.image_id = e.image_id and t.block_id = e.block_id and t.k = 1 left join mid on mid.image_id = e.image_id),
c as (select image_id, floor(ey/40)*40 + 20 "at", avg(mtf) "value" from v_edges group by 1, 2), h as (select *, row_number() over (partition by image_id order by value desc, "at") n from c),
g as (select o.image_id, block_id, edge_id, ey, mtf, quality, c.value, row_number() over (partition by o.image_id order by round(abs(c.at - ey), 9), c.at) k from o join c using (image_id) where n = 1)
select g.image_id, block_id, edge_id, ey as "position", ey - h.at shift, round(g.value, 9) on_curve, round(case when quality >= 0.5 then mtf else h.value end, 9) mtf, quality >= 0.5 good from g join h on h.image_id = g.image_id and h.n = 1 where k = 1""")
def _r21_reference(spark, d):
    e = edges(spark, d).withColumn("block_id", F.expr("edge_id div 16"))
    areas = e.groupBy("image_id", "block_id").agg(((F.max("ex") - F.min("ex")) * (F.max("ey") - F.min("ey"))).alias("area"))
    curve = e.groupBy("image_id", (F.floor(F.col("ey") / 40) * 40 + 20).alias("at")).agg(F.avg("mtf").alias("value"))
    return rounded(reports.reference_edge(e, areas, curve), "on_curve", "mtf", digits=9)


_CA = """n as (select edge_id, cast(par as int) % 3 channel, perp, v, trunc(perp*8 + 256) + d as bin from v_samples, (select unnest(range(-5, 6)) d)),
w as (select edge_id, channel, cast(bin as int) bin, v, greatest(0.0e0, 1 - 1.75e0*abs(perp - (bin - 256)/8.0e0)) w from n),
es as (select edge_id, channel, bin, sum(w*v)/sum(w) v from w where w > 0 and bin between 0 and 511 group by 1, 2, 3),
g as (select e.edge_id, e.channel, cast(b as int) bin from (select distinct edge_id, channel from es) e, (select unnest(range(0, 512)) b)),
p as (select g.edge_id, g.channel, g.bin, coalesce(last_value(v ignore nulls) over (partition by g.edge_id, g.channel order by g.bin rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by g.edge_id, g.channel order by g.bin rows between current row and unbounded following)) v from g left join es on g.edge_id = es.edge_id and g.channel = es.channel and g.bin = es.bin),
l as (select edge_id, channel, bin, case when bin between 224 and 288 then coalesce(lead(v) over (partition by edge_id, channel order by bin) - lag(v) over (partition by edge_id, channel order by bin), 0) else 0 end v from p)"""


def _channel_lsf(spark, d):
    k = ["edge_id", "channel"]
    s = view(spark, d, "v_samples").withColumn("channel", F.col("par").cast("int") % 3)
    return esf.lsf(esf.pad_missing(esf.bin_triangular(s, k), k), k, 224, 288)


_SHIFT = f"""{_CA}, c as (select edge_id, channel, sum(bin*abs(v))/sum(abs(v))/8 c from l group by 1, 2),
sh as (select edge_id, max(case when channel = 0 then c end) - max(case when channel = 1 then c end) red_px, max(case when channel = 2 then c end) - max(case when channel = 1 then c end) blue_px from c group by 1)"""


@register("r22_channel_shift", f"with {_SHIFT} select edge_id, round(red_px, 5) + 0.0e0 red_px, round(blue_px, 5) + 0.0e0 blue_px from sh")
def _r22(spark, d):
    return rounded(reports.channel_shift(_channel_lsf(spark, d), ["edge_id"]), "red_px", "blue_px", digits=5)


@register("r23_channel_lsf", f"with {_CA} select edge_id, channel, bin, round(v, 3) + 0.0e0 v from l")
def _r23(spark, d):
    return rounded(_channel_lsf(spark, d), "v", digits=3)


@register("r25_ca_percent", f"with {_SHIFT} select edge_id, round(100*red_px/greatest(1, sqrt(pow(ex - 320, 2) + pow(ey - 240, 2))), 6) + 0.0e0 red_pct, round(100*blue_px/greatest(1, sqrt(pow(ex - 320, 2) + pow(ey - 240, 2))), 6) + 0.0e0 blue_pct from sh join v_edges using (edge_id)")
def _r25(spark, d):
    m = reports.channel_shift(_channel_lsf(spark, d), ["edge_id"]).join(edges(spark, d), "edge_id")
    return rounded(reports.ca_percent(m, 320, 240), "red_pct", "blue_pct").select("edge_id", "red_pct", "blue_pct")


def _points(spark, d):
    return read_table(spark, d, "customer").select((F.col("c_custkey") % 4).cast("int").alias("image_id"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 71 % 640).cast("double").alias("px"), (F.col("c_custkey") * 29 % 480).cast("double").alias("py"))


@register("r27_nearest_edge", """with p as (select cast(c_custkey % 4 as int) image_id, c_custkey point_id, cast(c_custkey*71 % 640 as double) px, cast(c_custkey*29 % 480 as double) py from customer),
j as (select p.image_id, point_id, edge_id, round(sqrt(pow(px - ex, 2) + pow(py - ey, 2)), 6) d from p join v_edges using (image_id) where sqrt(pow(px - ex, 2) + pow(py - ey, 2)) <= 50),
r as (select *, row_number() over (partition by image_id, point_id order by d, edge_id) k from j) select image_id, point_id, edge_id, d distance from r where k = 1""")
def _r27(spark, d):
    return reports.nearest_edge(_points(spark, d), edges(spark, d))


@register("r28_match_captures", """with a as (select edge_id, image_id, ex, ey, mtf from v_edges), b as (select edge_id + 1000 edge_id, image_id, ex + 3 ex, ey - 2 ey, mtf*1.05e0 mtf from v_edges),
j as (select a.image_id, a.edge_id a, b.edge_id b, b.mtf - a.mtf delta, round(sqrt(pow(a.ex - b.ex, 2) + pow(a.ey - b.ey, 2)), 6) d from a join b using (image_id) where sqrt(pow(a.ex - b.ex, 2) + pow(a.ey - b.ey, 2)) <= 50),
r as (select *, row_number() over (partition by image_id, a order by d, b) ka, row_number() over (partition by image_id, b order by d, a) kb from j) select image_id, a, b, round(delta, 9) delta from r where ka = 1 and kb = 1""")
def _r28(spark, d):
    a = edges(spark, d)
    b = a.withColumns({"edge_id": F.col("edge_id") + 1000, "ex": F.col("ex") + 3, "ey": F.col("ey") - 2, "mtf": F.col("mtf") * 1.05})
    return rounded(reports.match_captures(a, b), "delta", digits=9)


_ACC = "m as (select l_linenumber as run, l_discount, cast(l_extendedprice as double) expected, cast(l_extendedprice as double)*(1 + (l_discount - 0.05)*0.2) measured from lineitem)"


def _measured(spark, d):
    p = F.col("l_extendedprice").cast("double")
    return read_table(spark, d, "lineitem").select(F.col("l_linenumber").alias("run"), p.alias("expected"), (p * (1 + (F.col("l_discount").cast("double") - 0.05) * 0.2)).alias("measured"))


@register("r29_accuracy_summary", f"with {_ACC} select run, round(avg(abs(measured - expected)), 4) mean_abs, round(quantile_cont(abs(measured - expected), 0.5), 4) median_abs, count(*) n from m group by 1")
def _r29(spark, d):
    return rounded(reports.accuracy_summary(_measured(spark, d), ["run"]), "mean_abs", "median_abs", digits=4)


@register("r30_relative_error_p95", f"with {_ACC} select run, round(quantile_cont(abs(100*(measured - expected)/expected), 0.95), 6) p95 from m group by 1")
def _r30(spark, d):
    return rounded(reports.relative_error_p95(_measured(spark, d), ["run"]), "p95")


@register("r14_spread_band")
def _r14(spark, d):
    """The running smoothing has no short SQL; the tests hold it against a loop."""
    e = view(spark, d, "v_events").select((F.col("edge_id") % 10).alias("edge_id"), (F.col("i") % 64).alias("i"), F.abs(F.col("v") - 20).alias("e"))
    return rounded(reports.spread_band(e, e, ["edge_id"]), "band", digits=5)


_SG7 = "[" + ", ".join(f"{x!r}::double" for x in __import__("acutance.operators.spectrum", fromlist=["x"]).smoothing_weights(7)) + "]"


@register("r15_smooth_profile", f"""with t as (select {_SG7} sg), n as (select edge_id, i, v, count(*) over (partition by edge_id) n from v_events)
select a.edge_id, a.i, round(case when count(b.i) = 15 then sum(b.v*sg[b.i - a.i + 8]) else any_value(a.v) end, 5) v from n a join n b on a.edge_id = b.edge_id and abs(a.i - b.i) <= 7, t group by 1, 2""")
def _r15(spark, d):
    return rounded(reports.smooth_profile(view(spark, d, "v_events"), ["edge_id"], "i", "v"), "v", digits=5)


@register("r17_is_rotated", """with rm as (select edge_id % 8 image_id, i, max(v) mtf from v_events group by 1, 2), ex as (select *, min(i) over (partition by image_id) lo, max(i) over (partition by image_id) hi from rm),
b as (select image_id, cast(least(59, floor((i - lo)*60/greatest(hi - lo, 1))) as int) bin, max(mtf) m from ex group by 1, 2), im as (select distinct image_id from b),
cuts as (select image_id, cast(p as int) p, cast(q as int) q from im, unnest(range(10, 31, 2)) a(p), unnest(range(32, 51, 2)) c(q)),
s as (select image_id, p, q, case when bin < p then 0 when bin < q then 1 else 2 end part, quantile_cont(m, 0.25) a, quantile_cont(m, 0.5) b, quantile_cont(m, 0.75) c from b join cuts using (image_id) group by 1, 2, 3, 4),
g as (select image_id, p, q, sum((c - a)*case when part = 1 then 10 else 1 end) cost, max(b) filter (part = 0) m0, max(b) filter (part = 1) m1, max(b) filter (part = 2) m2 from s group by 1, 2, 3 having count(*) = 3),
k as (select *, row_number() over (partition by image_id order by round(cost, 9), p, q) k from g) select image_id, p, q, m1 <= m0 and m1 <= m2 rotated from k where k = 1""")
def _r17(spark, d):
    rm = view(spark, d, "v_events").select((F.col("edge_id") % 8).alias("image_id"), F.col("i").alias("at"), F.col("v").alias("mtf"))
    return reports.is_rotated(rm.groupBy("image_id", "at").agg(F.max("mtf").alias("mtf")))


_WIDTHS = (5, 8, 11, 14, 17, 20)
_LINES = " union all ".join(f"select edge_id, i, n, {h} width, count(*) over w c, sum(n) over w sn, sum(v) over w sy, sum(n*n) over w snn, sum(n*v) over w sny from rw window w as (partition by edge_id order by n rows between {h} preceding and {h} following)" for h in _WIDTHS)


@register("r19_loess_auto", f"""with rw as (select *, cast(row_number() over (partition by edge_id order by i) as double) n from v_events), m as ({_LINES}),
sl as (select *, case when c*snn - sn*sn > 0 then (c*sny - sn*sy)/(c*snn - sn*sn) else 0 end slope from m), f as (select *, (sy - slope*sn)/c + slope*n fit from sl),
st as (select *, sign(round(fit - lag(fit) over (partition by edge_id, width order by n), 9)) d from f), tu as (select *, d*lag(d) over (partition by edge_id, width order by n) < 0 turn from st),
ra as (select edge_id, width, avg(case when turn then 1 else 0 end) rate from tu group by 1, 2), pk as (select edge_id, coalesce(min(width) filter (rate < 0.05), max(width)) width from ra group by 1)
select edge_id, i, width, round(fit, 7) + 0.0e0 fit from tu join pk using (edge_id, width)""")
def _r19(spark, d):
    return rounded(reports.loess_auto(view(spark, d, "v_events"), ["edge_id"], "i", "v"), "fit", digits=7)


@register("r26_ca_surface", f"""{"with " + _SHIFT}, e as (select v_edges.edge_id, image_id, ex, ey, angle, red_px*40 red from v_edges join sh on sh.edge_id = v_edges.edge_id % 20), en as (select image_id from e group by 1 having count(*) >= 6),
d as (select *, ex - 320 dx, ey - 240 dy from e where abs(red) <= 16 and image_id in (select image_id from en)), c2 as (select *, {_COS} c from d),
g2 as (select image_id, case when c > cos(radians(45)) then 'meridional' else 'sagittal' end direction, cast(round_even(ey/80, 0) as int) gy, cast(round_even(ex/80, 0) as int) gx, round(red, 4) red from c2),
r2 as (select *, row_number() over (partition by image_id, direction, gy, gx order by abs(red) desc, red desc) k from g2) select image_id, direction, gy, gx, red + 0.0e0 v from r2 where k = 1""")
def _r26(spark, d):
    return reports.ca_surface(_red_shifts(spark, d), 80.0, "red")


def _red_shifts(spark, d):
    s = reports.channel_shift(_channel_lsf(spark, d), ["edge_id"]).withColumnRenamed("edge_id", "e20")
    m = edges(spark, d).withColumn("e20", F.col("edge_id") % 20).join(s, "e20").withColumn("red", F.round(F.col("red_px") * 40, 4) + 0.0)
    return reports.classify_ms(m.where("abs(red_px * 40) <= 16"), 320, 240)


@register("r26_ca_map")
def _r26_map(spark, d):
    return rounded(reports.ca_map(_red_shifts(spark, d), 640, 480, 24.0, "red", "percent", sparse=True, step=2), "v")
