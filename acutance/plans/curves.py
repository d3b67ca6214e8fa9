"""Queries of the edge-spread and spectrum operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acutance.operators import esf, spectrum
from acutance.plans.registry import register, view

EK = ["edge_id"]

_NEAR = """n as (select edge_id, perp, v, trunc(perp*8 + 256) + d as bin from v_samples, (select unnest(range(-5, 6)) d)),
w as (select edge_id, cast(bin as int) bin, v, greatest(0.0e0, 1 - 1.75e0*abs(perp - (bin - 256)/8.0e0)) w from n),
esf as (select edge_id, bin, sum(w*v)/sum(w) v from w where w > 0 and bin between 0 and 511 group by 1, 2)"""
_PAD = """,
g as (select e.edge_id, cast(b as int) bin from (select distinct edge_id from esf) e, (select unnest(range(0, 512)) b)),
p as (select g.edge_id, g.bin, coalesce(last_value(v ignore nulls) over (partition by g.edge_id order by g.bin rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by g.edge_id order by g.bin rows between current row and unbounded following)) v from g left join esf on g.edge_id = esf.edge_id and g.bin = esf.bin)"""
_LSF = """,
l as (select edge_id, bin, coalesce(lead(v) over (partition by edge_id order by bin) - lag(v) over (partition by edge_id order by bin), 0) v from p)"""
_SFR = """,
f as (select edge_id, k, sqrt(pow(sum(v*cos(2*pi()*((bin*k) % 512)/512)), 2) + pow(sum(v*sin(2*pi()*((bin*k) % 512)/512)), 2)) m from l, (select unnest(range(0, 64)) k) group by 1, 2),
s as (select edge_id, cast(k as int) k, m/max(case when k = 0 then m end) over (partition by edge_id) / case when k = 0 then 1 else sin(2*pi()*k/512)/(2*pi()*k/512) end m from f)"""
ESF, PAD, LSF, SFR = f"with {_NEAR}", f"with {_NEAR}{_PAD}", f"with {_NEAR}{_PAD}{_LSF}", f"with {_NEAR}{_PAD}{_LSF}{_SFR}"


def samples(spark, d):
    return view(spark, d, "v_samples")


def padded(spark, d):
    return esf.pad_missing(esf.bin_triangular(samples(spark, d), EK), EK)


def sfr(spark, d):
    return spectrum.correct(spectrum.dft(esf.lsf(padded(spark, d), EK), EK))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@register("b1_bin_triangular", ESF + " select edge_id, bin, round(v, 4) v from esf")
def _b1(spark, d):
    return rounded(esf.bin_triangular(samples(spark, d), EK), "v", digits=4)


@register("b2_pad_missing", PAD + " select edge_id, bin, round(v, 4) v from p")
def _b2(spark, d):
    return rounded(padded(spark, d), "v", digits=4)


_SL = """,
sl as (select edge_id, bin, v, case when count(*) over w = 33 then (sum(bin*v) over w - bin*sum(v) over w)/2992.0e0 end slope from p
  window w as (partition by edge_id order by bin rows between 16 preceding and 16 following))"""


@register("b3_slopes", PAD + _SL + " select edge_id, bin, round(v, 3) v, round(slope, 3) + 0.0e0 slope from sl")
def _b3(spark, d):
    return rounded(esf.slopes(padded(spark, d), EK), "v", "slope", digits=3)


@register("b4_reject_shifted_peak", PAD + _SL + """, r as (select edge_id, bin, row_number() over (partition by edge_id order by abs(slope) desc, bin) n from sl where slope is not null)
select edge_id, bin peak_bin, not (abs(bin - 256) > 16 and abs(bin - 256) < 96) accepted from r where n = 1""")
def _b4(spark, d):
    return esf.reject_shifted_peak(esf.slopes(padded(spark, d), EK), EK)


@register("b6_transition_width", PAD + """,
s as (select edge_id, bin, avg(v) over (partition by edge_id order by bin rows between 2 preceding and 2 following) s from p),
x as (select *, min(s) over (partition by edge_id) lo, max(s) over (partition by edge_id) hi from s),
a as (select edge_id, bin, row_number() over (partition by edge_id order by round(abs(s - lo - 0.1e0*(hi - lo)), 6), bin) n1,
  row_number() over (partition by edge_id order by round(abs(s - lo - 0.9e0*(hi - lo)), 6), bin) n9 from x),
b as (select edge_id, max(case when n1 = 1 then bin end) bin10, max(case when n9 = 1 then bin end) bin90 from a group by 1),
r as (select *, greatest(4.0e0, abs(bin90 - bin10)/8.0e0) rise from b)
select edge_id, bin10, bin90, rise, cast(greatest(abs(greatest(bin10, bin90) + 4 + 2*round_even(rise, 0) - 256), abs(least(bin10, bin90) - 4 - 2*round_even(rise, 0) - 256)) as int) half_width from r""")
def _b6(spark, d):
    return esf.transition_width(padded(spark, d), EK)


_SNR = PAD + """,
ends as (select edge_id, avg(case when bin < 16 then v end) l, avg(case when bin >= 496 then v end) r from p group by 1),
e as (select s.edge_id, s.perp, pow(s.v - p.v, 2) e2 from v_samples s join p on s.edge_id = p.edge_id and p.bin = trunc(s.perp*8 + 256) where abs(s.perp) > 8),
sd as (select edge_id, sqrt(avg(case when perp < 0 then e2 end)) sl, sqrt(avg(case when perp > 0 then e2 end)) sr from e group by 1),
snr as (select edge_id, least(l, r) dark_mean, greatest(l, r) bright_mean, case when l > r then sr else sl end dark_sd, case when l > r then sl else sr end bright_sd from ends join sd using (edge_id))"""


@register("b7_snr", _SNR + " select edge_id, round(dark_mean, 3) dark_mean, round(bright_mean, 3) bright_mean, round(dark_sd, 3) dark_sd, round(bright_sd, 3) bright_sd from snr")
def _b7(spark, d):
    return rounded(esf.snr(samples(spark, d), padded(spark, d), EK), "dark_mean", "bright_mean", "dark_sd", "bright_sd", digits=3)


@register("b8_snr_ratios", _SNR + """, x as (select *, greatest(dark_sd, 0.01) a, greatest(bright_sd, 0.01) b, bright_mean - dark_mean c from snr)
select edge_id, round(c, 3) contrast, round(least(c/((a + b)/2), 10000), 4) mean_cnr, round(least(c/a, 10000), 4) dark_cnr, round(least(c/b, 10000), 4) bright_cnr,
  round(least(dark_mean/a, 10000), 4) dark_snr, round(least(bright_mean/b, 10000), 4) bright_snr from x""")
def _b8(spark, d):
    out = esf.snr_ratios(esf.snr(samples(spark, d), padded(spark, d), EK))
    return rounded(rounded(out, "contrast", digits=3), "mean_cnr", "dark_cnr", "bright_cnr", "dark_snr", "bright_snr", digits=4).drop("dark_mean", "bright_mean", "dark_sd", "bright_sd")


@register("b9_oversampling", "select edge_id, count(distinct floor(perp*8))/8.0e0 oversampling from v_samples where perp >= -4 and perp < 4 group by 1")
def _b9(spark, d):
    return esf.oversampling(samples(spark, d), EK)


@register("b14_smooth_tails", PAD + """ select edge_id, bin, round(case when abs(bin - 256) > 64 then avg(v) over (partition by edge_id order by bin rows between 8 preceding and 8 following) else v end, 4) v from p""")
def _b14(spark, d):
    return rounded(esf.smooth_tails(padded(spark, d), EK), "v", digits=4)


@register("b15_smooth_gauss", PAD + """ select a.edge_id, a.bin, round(sum(pow(0.5e0, (b.bin - a.bin)*(b.bin - a.bin)/16.0e0)*b.v)/sum(pow(0.5e0, (b.bin - a.bin)*(b.bin - a.bin)/16.0e0)), 4) v
from p a join p b on a.edge_id = b.edge_id and b.bin between a.bin - 4 and a.bin + 4 group by 1, 2""")
def _b15(spark, d):
    return rounded(esf.smooth_gauss(padded(spark, d), EK), "v", digits=4)


@register("b16_monotone", """with e as (select edge_id, (i - 1) // 64 seg, (i - 1) % 64 i, v from v_events),
s as (select *, sum(v) over (partition by edge_id, seg order by i) s from e),
m as (select a.edge_id, a.seg, a.i a, b.i b, (b.s - a.s + a.v)/(b.i - a.i + 1) m from s a join s b on a.edge_id = b.edge_id and a.seg = b.seg and b.i >= a.i),
l as (select edge_id, seg, a, b i, min(m) over (partition by edge_id, seg, a order by b rows between current row and unbounded following) low from m),
f as (select edge_id, seg, i, max(low) fit from l group by 1, 2, 3)
select s.edge_id, s.seg, s.i, round(s.v, 6) v, round(f.fit, 6) fit from s join f on s.edge_id = f.edge_id and s.seg = f.seg and s.i = f.i""")
def _b16(spark, d):
    """Each run of 64 events of a user is a curve."""
    e = view(spark, d, "v_events").withColumn("seg", F.expr("cast((i - 1) div 64 as int)")).withColumn("i", (F.col("i") - 1) % 64)
    return rounded(esf.monotone(e, ["edge_id", "seg"]), "v", "fit")


@register("b17_lsf", LSF + " select edge_id, bin, round(v, 3) + 0.0e0 v from l")
def _b17(spark, d):
    return rounded(esf.lsf(padded(spark, d), EK), "v", digits=3)


@register("b18_lsf_display", LSF + " select edge_id, bin, round(v/2*case when sum(v) over (partition by edge_id) < 0 then -1 else 1 end, 3) + 0.0e0 v from l")
def _b18(spark, d):
    return rounded(esf.lsf_display(padded(spark, d), EK), "v", digits=3)


@register("b19_orient_rising", PAD + """,
q as (select edge_id, bin, case when edge_id % 2 = 1 then -v else v end v from p),
m as (select q.edge_id, q.bin, q.v, r.v mv from q join q r on q.edge_id = r.edge_id and r.bin = 511 - q.bin),
f as (select edge_id, 2*count(*) filter (v > mv) > count(*) falls from m where bin < 16 group by 1)
select edge_id, bin, round(case when falls then mv else v end, 4) v from m join f using (edge_id)""")
def _b19(spark, d):
    mixed = padded(spark, d).withColumn("v", F.when(F.col("edge_id") % 2 == 1, -F.col("v")).otherwise(F.col("v")))
    return rounded(esf.orient_rising(mixed, EK), "v", digits=4)


@register("f1_dft", LSF + _SFR + " select edge_id, k, round(m*case when k = 0 then 1 else sin(2*pi()*k/512)/(2*pi()*k/512) end, 6) m from s")
def _f1(spark, d):
    return rounded(spectrum.dft(esf.lsf(padded(spark, d), EK), EK), "m")


@register("f1_dft_embeddings", """with e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 bin from embeddings),
f as (select vec_id, cast(k as int) k, sqrt(pow(sum(v*cos(2*pi()*((bin*k) % 64)/64)), 2) + pow(sum(v*sin(2*pi()*((bin*k) % 64)/64)), 2)) m from e, (select unnest(range(0, 8)) k) group by 1, 2)
select vec_id, k, round(m/max(case when k = 0 then m end) over (partition by vec_id), 4) m from f""")
def _f1e(spark, d):
    """The transform of packed curves of 64 points."""
    from acutance.session import read_table

    e = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "x")).select("vec_id", "bin", F.col("x").cast("double").alias("v"))
    return rounded(spectrum.dft(e, ["vec_id"], 64, 8), "m", digits=4)


@register("f2_derivative_correction", "select edge_id, cast(k as int) k, round(case when k = 0 then 1 else sin(2*pi()*k/512)/(2*pi()*k/512) end, 9) c from (select distinct edge_id from v_samples), (select unnest(range(0, 64)) k)")
def _f2(spark, d):
    edges = samples(spark, d).select("edge_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return edges.withColumn("c", F.round(spectrum.sinc_correction(F.col("k")), 9))


@register("f6_correct", SFR + " select edge_id, k, round(m, 6) m from s")
def _f6(spark, d):
    return rounded(sfr(spark, d), "m")


_MTF = """,
b as (select *, lag(m) over (partition by edge_id order by k) pm from s),
c as (select edge_id, k, (k - 1 + (pm - 0.5e0)/(pm - m))/64 f, row_number() over (partition by edge_id order by k) n from b where pm > 0.5 and m <= 0.5),
mtf as (select e.edge_id, c.k, c.f mtf50 from (select distinct edge_id from s) e left join c on e.edge_id = c.edge_id and n = 1)"""


@register("f7_mtf50_slice", SFR + _MTF + " select edge_id, k, round(mtf50, 6) mtf50 from mtf")
def _f7(spark, d):
    return rounded(spectrum.mtf_crossing(sfr(spark, d), EK), "mtf50")


@register("f9_not_available", SFR + _MTF + """, a as (select *, edge_id*0.04e0 reduced_angle from mtf)
select edge_id, k, round(case when reduced_angle >= 0.1 then mtf50 end, 6) mtf50, reduced_angle, mtf50 is not null and reduced_angle >= 0.1 valid from a""")
def _f9(spark, d):
    m = spectrum.mtf_crossing(sfr(spark, d), EK).withColumn("reduced_angle", F.col("edge_id") * 0.04)
    return rounded(spectrum.not_available(m), "mtf50")


_Q = """case when angle % 45 <= 1 or angle % 45 >= 44 then 0.5e0 when abs(angle % 45 - 26.565e0) < 1 then 0.8e0 else 1 end"""


@register("f10_edge_quality", f"""with q as (select edge_id, case when ex < 100 then {_Q}*0.5e0 else {_Q} end q, quality = 0.2 con, mtf < 0.35 us from v_edges)
select edge_id, case when not us then 0 when con then 0.2e0 else q end quality from q""")
def _f10(spark, d):
    e = view(spark, d, "v_edges")
    q = spectrum.edge_quality(F.col("angle") % 45, F.col("ex") / 4, F.col("quality") == 0.2, F.col("mtf") < 0.35)
    return e.select("edge_id", q.alias("quality"))


@register("f11_accept_edges", """with e as (select *, case when image_id = 3 then 0.0e0 else mtf*4 end m from v_edges),
a as (select *, max(case when m > 1e-6 then 1 else 0 end) over (partition by image_id) ok from e) select edge_id, image_id, round(m, 9) mtf from a where m <= 1.2 and ok = 1""")
def _f11(spark, d):
    e = view(spark, d, "v_edges").withColumn("mtf", F.when(F.col("image_id") == 3, 0.0).otherwise(F.col("mtf") * 4))
    return rounded(spectrum.accept_edges(e, ["image_id"]), "mtf", digits=9).select("edge_id", "image_id", "mtf")


@register("f12_to_lpmm", "select edge_id, round(mtf*1000/(3 + image_id), 6) lpmm from v_edges")
def _f12(spark, d):
    e = view(spark, d, "v_edges")
    images = e.select("image_id").distinct().withColumn("pixel_um", (F.col("image_id") + 3).cast("double"))
    return rounded(spectrum.to_lpmm(e, images), "lpmm").select("edge_id", "lpmm")


@register("f14_upsample_sfr", SFR + """,
ww as (select edge_id, k, m p1, lead(m) over (partition by edge_id order by k) p2, lag(m) over (partition by edge_id order by k) p0, lead(m, 2) over (partition by edge_id order by k) p3 from s),
x as (select edge_id, k, p1, p2, coalesce(p0, 2*p1 - p2) p0, coalesce(p3, 2*p2 - p1) p3, st/20.0e0 t from ww, (select unnest(range(0, 20)) st) where p2 is not null)
select edge_id, round((k + t)/64, 9) f, round(p1 + 0.5e0*t*(p2 - p0 + t*(2*p0 - 5*p1 + 4*p2 - p3 + t*(3*(p1 - p2) + p3 - p0))), 5) m from x""")
def _f14(spark, d):
    return rounded(rounded(spectrum.upsample(sfr(spark, d), EK), "f", digits=9), "m", digits=5)


@register("f15_contrast_at", SFR + " select edge_id, round(max(case when k = 6 then m end) + (max(case when k = 7 then m end) - max(case when k = 6 then m end))*0.4e0, 6) contrast from s group by 1")
def _f15(spark, d):
    return rounded(spectrum.contrast_at(sfr(spark, d), EK, 0.1), "contrast")


@register("f16_contrast_step_at", SFR + " select edge_id, round(max(case when k = 6 then m end), 6) contrast from s group by 1")
def _f16(spark, d):
    return rounded(spectrum.contrast_step_at(sfr(spark, d), EK, 0.1), "contrast")


_NEARA = lambda tol: f"(a < {tol} or a > 45 - {tol} or abs(a - 26.565e0) < {tol})"


@register("f17_quality_flags", f"""with e as (select edge_id, angle % 45 a, ex/10 cnr, ey/30 ov, ex len from v_edges)
select edge_id, case when cnr < 20 then 'red' when cnr < 30 then 'yellow' else 'ok' end cnr_flag, case when {_NEARA(1)} then 'red' when {_NEARA(2)} then 'yellow' else 'ok' end angle_flag,
  case when ov <= 4 then 'red' when ov < 8 then 'yellow' else 'ok' end oversampling_flag, case when len <= 25 then 'red' when len > 400 then 'yellow' else 'ok' end length_flag from e""")
def _f17(spark, d):
    e = view(spark, d, "v_edges").select("edge_id", (F.col("angle") % 45).alias("reduced_angle"), (F.col("ex") / 10).alias("cnr"), (F.col("ey") / 30).alias("oversampling"), F.col("ex").alias("length"))
    return spectrum.quality_flags(e).select("edge_id", "cnr_flag", "angle_flag", "oversampling_flag", "length_flag")


@register("b5_clip_contaminated", PAD + """,
bump as (select edge_id, bin, v + case when edge_id % 3 = 0 and bin > 380 then -60.0e0*(bin - 380) when edge_id % 3 = 1 and bin < 120 then 45.0e0*(120 - bin) else 0 end v from p),
sl as (select edge_id, bin, coalesce(case when count(*) over w = 33 then (sum(bin*v) over w - bin*sum(v) over w)/2992.0e0 end, 0) s from bump window w as (partition by edge_id order by bin rows between 16 preceding and 16 following)),
pk as (select edge_id, arg_max(s, struct_pack(a := round(abs(s), 9), b := -bin)) peak from sl where abs(bin - 256) <= 16 group by 1), q as (select sl.*, peak, s*peak < 0 ag from sl join pk using (edge_id)),
t as (select *, count(*) filter (ag) over l bl, max(abs(s)) filter (ag) over l/abs(peak) dl, count(*) over l nl, count(*) filter (ag) over r br, max(abs(s)) filter (ag) over r/abs(peak) dr, count(*) over r nr from q
  window l as (partition by edge_id order by bin rows between unbounded preceding and current row), r as (partition by edge_id order by bin rows between current row and unbounded following)),
g5 as (select edge_id, max(case when ag and abs(s) > abs(peak)*0.001 and ((bl > nl*0.4 and dl > 0.25) or (bl > 0.9*nl and nl > 16)) and bin between 4 and 240 then bin end) lo,
  min(case when ag and abs(s) > abs(peak)*0.001 and ((br > nr*0.4 and dr > 0.25) or (br > 0.9*nr and nr > 16)) and bin between 272 and 507 then bin end) hi from t group by 1)
select edge_id, coalesce(lo, 0) "left", coalesce(hi, 511) "right", lo is not null or hi is not null clipped, (lo is not null or hi is not null) and (256 - coalesce(lo, 0) < 32 or coalesce(hi, 511) - 256 < 32) contaminated from g5""")
def _b5(spark, d):
    third, b = F.col("edge_id") % 3, F.col("bin")
    bump = F.when((third == 0) & (b > 380), -60.0 * (b - 380)).when((third == 1) & (b < 120), 45.0 * (120 - b)).otherwise(0.0)
    return esf.clip_contaminated(esf.slopes(padded(spark, d).withColumn("v", F.col("v") + bump), EK), EK)


_HW = "hw as (select edge_id, 20 + edge_id % 7 t from (select distinct edge_id from v_samples))"
_K10 = f"""with {_HW}, ks as (select s.edge_id, perp, v, t, cast(trunc(perp*8 + 256) as int) c from v_samples s join hw using (edge_id)),
kn as (select *, case when abs(c - 256) > 1.0e0*t then 12 when abs(c - 256) > 0.5e0*t then 7 else 5 end n from ks), kr as (select *, greatest(0, c - n) lo, least(511, c + n) hi from kn),
kb as (select edge_id, perp, v, t, lo, hi, cast(bin as int) bin from (select *, unnest(range(lo, hi + 1)) bin from kr where lo <= hi)),
kf as (select *, abs(bin - 256) far, perp - (bin - 256)/8.0e0 x from kb), kg as (select *, (far/cast(t as double) - 0.5e0)/1.35e0 a from kf),
kw as (select *, case when far < 0.5e0*t then 13.0e0 else 13.0e0*(1 - a + 0.01e0*a) end rate, hi < 256 - 1.85e0*t or lo > 256 + 1.85e0*t or far >= 1.85e0*t box from kg),
kx as (select *, case when box then 1 when abs(x) < 0.0625e0 then (2 - 2*exp(-rate*0.0625e0)*cosh(rate*x))/(2*sinh(rate*0.0625e0)*(1 - exp(-rate*0.0625e0))) else exp(-rate*abs(x))/(1 - exp(-rate*0.0625e0)) end w from kw),
kesf as (select edge_id, bin, sum(w*v)/sum(w) v from kx group by 1, 2)"""


def kernel_esf(spark, d):
    s = samples(spark, d)
    width = s.select("edge_id").distinct().withColumn("half_width", 20 + F.col("edge_id") % 7)
    return esf.esf_kernel(s, width, EK)


@register("b10_esf_kernel", _K10 + " select edge_id, bin, round(v, 4) v from kesf")
def _b10(spark, d):
    return rounded(kernel_esf(spark, d), "v", digits=4)


@register("b11_tail_fill", _K10 + """, kq as (select * from kesf where not (bin < 60 + edge_id or bin > 450 or bin between 300 and 303)),
kz as (select *, row_number() over (partition by edge_id order by bin) u, row_number() over (partition by edge_id order by bin desc) d from kq),
ke as (select edge_id, avg(case when u <= 24 and bin < 256 then v end) lv, avg(case when d <= 24 and bin > 256 then v end) rv, min(bin) b0, max(bin) b1 from kz group by 1),
kj as (select ke.*, cast(b as int) bin from ke, (select unnest(range(0, 512)) b)), kk as (select kj.*, kq.v, last_value(case when v is not null then kj.bin end ignore nulls) over a pb, last_value(v ignore nulls) over a pv,
  first_value(case when v is not null then kj.bin end ignore nulls) over z qb, first_value(v ignore nulls) over z qv from kj left join kq on kj.edge_id = kq.edge_id and kj.bin = kq.bin
  window a as (partition by kj.edge_id order by kj.bin rows between unbounded preceding and current row), z as (partition by kj.edge_id order by kj.bin rows between current row and unbounded following))
select edge_id, bin, round(case when bin < b0 then lv when bin > b1 then rv else coalesce(v, pv + (qv - pv)*(bin - pb)/greatest(qb - pb, 1)) end, 4) v from kk""")
def _b11(spark, d):
    b = F.col("bin")
    holes = kernel_esf(spark, d).where(~((b < 60 + F.col("edge_id")) | (b > 450) | b.between(300, 303)))
    return rounded(esf.tail_fill(holes, EK), "v", digits=4)


@register("b13_lut_interp", "select edge_id, ex, round(case when ex <= 50 then 1.0e0 when ex < 100 then 1 + (ex - 50)*(3.0e0 - 1)/50 when ex < 400 then 3 + (ex - 100)*(2.0e0 - 3)/300 else 2 end, 9) y from v_edges")
def _b13(spark, d):
    return rounded(esf.lut_interp(view(spark, d, "v_edges").select("edge_id", "ex"), [(50.0, 1.0), (100.0, 3.0), (400.0, 2.0)], "ex", "y"), "y", digits=9)


@register("f3_kernel_correction", """with x as (select i/128.0e0 x from (select unnest(range(-80, 81)) i)), w as (select x, case when abs(x) < 0.0625e0 then (2 - 2*exp(-13*0.0625e0)*cosh(13*x))/(2*sinh(13*0.0625e0)*(1 - exp(-13*0.0625e0))) else exp(-13*abs(x))/(1 - exp(-13*0.0625e0)) end w from x),
c as (select cast(k as int) k, abs(sum(w*cos(2*pi()*k/64*x)))/sum(w) c from w, (select unnest(range(0, 64)) k) group by 1)
select edge_id, k, round(c, 8) c from c, (select distinct edge_id from v_samples)""")
def _f3(spark, d):
    table = F.array(*[F.lit(x) for x in spectrum.kernel_correction(freqs=64)])
    e = samples(spark, d).select("edge_id").distinct()
    return rounded(e.select("edge_id", F.posexplode(table).alias("k", "c")), "c", digits=8)


def complex_sfr(spark, d):
    """Spectra of 128 frequencies with their parts, of the first difference of each curve."""
    t = F.broadcast(spectrum.twiddles(spark, 512, 128))
    lsf_rows = esf.lsf(padded(spark, d), EK)
    s = lsf_rows.join(t, "bin").groupBy("edge_id", "k").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))
    from pyspark.sql.window import Window

    m = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    return s.withColumn("m", m / F.max(F.when(F.col("k") == 0, m)).over(Window.partitionBy("edge_id")))


@register("f4_unbounce")
def _f4(spark, d):
    return rounded(spectrum.unbounce(complex_sfr(spark, d), EK), "m")


_SG = ", ".join("[" + ", ".join(f"{x!r}::double" for x in [0.0] * (7 - h) + spectrum.smoothing_weights(h) + [0.0] * (7 - h)) + "]" for h in range(2, 8))


def _pass(src: str, to: str) -> str:
    return f"""{to}0 as (select a.edge_id, a.k, case when a.k < 7 or a.k >= 119 then any_value(a.m) else sum(b.m*sg[cast(least(5, floor((a.k - 5)/3)) as int) + 1][b.k - a.k + 8]) end m
  from {src} a join {src} b on a.edge_id = b.edge_id and abs(a.k - b.k) <= 7, wt group by 1, 2), {to} as (select edge_id, k, m/max(case when k = 0 then m end) over (partition by edge_id) m from {to}0)"""


@register("f5_smooth_sfr", LSF + f""", f as (select edge_id, cast(k as int) k, sqrt(pow(sum(v*cos(2*pi()*((bin*k) % 512)/512)), 2) + pow(sum(v*sin(2*pi()*((bin*k) % 512)/512)), 2)) m from l, (select unnest(range(0, 128)) k) group by 1, 2),
s0 as (select edge_id, k, m/max(case when k = 0 then m end) over (partition by edge_id) m from f), wt as (select [{_SG}] sg), t5 as (select [-0.086e0, 0.343e0, 0.486e0, 0.343e0, -0.086e0] w5),
x0 as (select a.edge_id, a.k, case when a.k >= 125 then any_value(a.m) else sum(b.m*w5[d + 3]) end m from s0 a, (select unnest(range(-2, 3)) d), t5, s0 b where a.edge_id = b.edge_id and b.k = abs(a.k + d) group by 1, 2),
{_pass('x0', 'y1')}, {_pass('y1', 'y2')}, {_pass('y2', 'y3')} select edge_id, k, round(abs(m), 5) + 0.0e0 m from y3""")
def _f5(spark, d):
    return rounded(spectrum.smooth_sfr(complex_sfr(spark, d).select("edge_id", "k", "m"), EK), "m", digits=5)


@register("f8_refine_crossing", SFR + _MTF + """, cx as (select edge_id, k k0, mtf50 lin, least(greatest(2, k - 9), 9) h from mtf where k >= 5 and k < 118),
n8 as (select s.edge_id, k0, lin, m y, k - k0 x from s join cx on s.edge_id = cx.edge_id and abs(s.k - k0) <= h),
m8 as (select edge_id, k0, lin, count(*)::double s0, sum(y) s1, sum(y*y) s2, sum(y*y*y) s3, sum(y*y*y*y) s4, sum(x) t0, sum(x*y) t1, sum(x*y*y) t2 from n8 group by 1, 2, 3),
d8 as (select *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) det from m8),
z8 as (select edge_id, k0, lin, ((t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0))/det*0.25e0 + (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - s2*t1))/det*0.5e0 + (s4*(s2*t0 - s1*t1) - s3*(s3*t0 - s2*t1) + t2*(s3*s1 - s2*s2))/det + k0)/64 mid from d8)
select mtf.edge_id, round(coalesce(case when k0 > 9 then mid else lin + (k0 - 5)/512.0e0/8*(mid - lin) end, mtf50), 5) mtf50 from mtf left join z8 using (edge_id)""")
def _f8(spark, d):
    s = sfr(spark, d)
    return rounded(spectrum.refine_crossing(s, spectrum.mtf_crossing(s, EK), EK), "mtf50", digits=5)
