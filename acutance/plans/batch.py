"""Queries of sources, sinks, job status and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from acutance.operators import measure, reports
from acutance.plans import curves, reporting, shapes
from acutance.plans.curves import _MTF, PAD, SFR, rounded
from acutance.plans.rasters import px
from acutance.plans.registry import register, view
from acutance.session import materialise, read_table, shared_path
from acutance.sources import tables
from acutance.streaming import arrivals

_B = "with b as (select edge_id // 4 block_id, edge_id % 4 k, image_id, edge_id, ex, ey, angle, mtf, quality from v_edges)"


def edge_rows(spark, d):
    e = view(spark, d, "v_edges")
    sfr = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(F.col("edge_id") % 11 == 0, F.when(i == 0, 0.0).otherwise(0.5)).otherwise(F.exp(-i * F.col("mtf") / 4)))
    return e.withColumns({"block_id": F.expr("edge_id div 4").cast("int"), "k": F.col("edge_id") % 4, "corner_x": F.col("ex") + 3, "corner_y": F.col("ey") - 3, "mean_cnr": F.col("ex") / 10, "oversampling": F.col("ey") / 30, "length": F.col("ex") / 4, "reduced_angle": F.col("angle") % 45, "radial_angle": F.col("angle") % 90, "sfr": sfr})


@register("s1_read_pixels", "select image_id, 0 channel, y, cast(row_number() over (partition by image_id, y order by x) - 1 as int) x, v from v_pixels where image_id <> 3")
def _s1(spark, d):
    path = shared_path(spark, "scanlines")
    tables.scanlines(px(spark, d).withColumn("channel", F.lit(0))).write.parquet(path)
    images = px(spark, d).select("image_id").distinct().withColumn("bit_depth", F.when(F.col("image_id") == 3, 32).otherwise(16))
    return tables.read_pixels(spark, path, images)[0]


@register("s2_read_rois", """with l as (select edge_id, case edge_id % 4 when 0 then ' 1 2  3 ' || edge_id when 1 then '1 2 3' when 2 then 'a 2 3 4' else edge_id || ' 2.5 3 4' end s from v_edges)
select edge_id, case when edge_id % 4 = 0 then 1.0e0 else edge_id end ax, case when edge_id % 4 = 0 then 2.0e0 else 2.5e0 end ay, 3.0e0 bx, case when edge_id % 4 = 0 then edge_id else 4.0e0 end as "by" from l where edge_id % 4 in (0, 3)""")
def _s2(spark, d):
    e, i = view(spark, d, "v_edges"), F.col("edge_id")
    value = F.when(i % 4 == 0, F.concat(F.lit(" 1 2  3 "), i)).when(i % 4 == 1, F.lit("1 2 3")).when(i % 4 == 2, F.lit("a 2 3 4")).otherwise(F.concat(i, F.lit(" 2.5 3 4")))
    return tables.parse_rois(e.select("edge_id", value.alias("value")))


@register("s3_write_measurements", "select image_id, edge_id // 4 block_id, ex, ey, round(mtf, 9) mtf, ex + 3 corner_x, ey - 3 corner_y, ex/10 mean_cnr, round(ey/30, 9) oversampling, ex/4 length from v_edges where edge_id % 11 <> 0")
def _s3(spark, d):
    path = shared_path(spark, "measurements")
    tables.write_measurements(edge_rows(spark, d), path, 2)
    return rounded(spark.read.parquet(path), "mtf", "oversampling", digits=9)


@register("s4_write_sfr", """with t as (select image_id, mtf, edge_id, unnest(range(0, 16)) i from v_edges)
select image_id, count(*) // 16 n, round(sum(round(case when edge_id % 11 = 0 then (case when i = 0 then 0.0e0 else 0.5e0 end) else exp(-i*mtf/4) end, 4)), 2) total from t group by 1""")
def _s4(spark, d):
    """The lines are read back: their number and the sum of their responses, which follow five numbers."""
    path = shared_path(spark, "sfr")
    tables.write_sfr(edge_rows(spark, d), path, 1)
    numbers = F.transform(F.slice(F.split("value", " "), 6, 16), lambda x: x.cast("double"))
    lines = spark.read.text(path).withColumn("total", F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x))
    return rounded(lines.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("total").alias("total")), "total", digits=2)


@register("s6_write_raw_mtf", _B + " select image_id, block_id, list(round(mtf, 9) order by k, mtf) mtfs from b where abs((angle - 20 + 90) % 180 + case when (angle - 20 + 90) % 180 < 0 then 180 else 0 end - 90) <= 15 group by 1, 2")
def _s6(spark, d):
    return tables.raw_mtf(rounded(edge_rows(spark, d), "mtf", digits=9), 20.0, 15.0)


@register("s7_write_raw_sfr", SFR + " select edge_id, list(round(m, 6) order by k) sfr from s group by 1")
def _s7(spark, d):
    return tables.pack_curve(rounded(curves.sfr(spark, d), "m"), ["edge_id"], "k", "m", "sfr")


@register("s8_write_esf", PAD + " select edge_id, 0.125e0 spacing, count(*) n, list(round(v, 3) order by bin) esf from p group by 1")
def _s8(spark, d):
    e = tables.pack_curve(rounded(curves.padded(spark, d), "v", digits=3), ["edge_id"], "bin", "v", "esf")
    return e.select("edge_id", F.lit(0.125).alias("spacing"), F.size("esf").cast("long").alias("n"), "esf")


@register("s9_write_edge_records", "select image_id, count(*) filter (mtf is not null) n_edges from v_edges group by 1")
def _s9(spark, d):
    e = edge_rows(spark, d)
    return tables.edge_records(e, e.select("image_id").distinct())[1]


@register("s10_read_edge_records", "select image_id, edge_id, ex, ey, round(mtf, 9) mtf, 16 n from v_edges")
def _s10(spark, d):
    path = shared_path(spark, "edge-records")
    e = edge_rows(spark, d)
    tables.edge_records(e, e.select("image_id").distinct())[0].write.parquet(path)
    return rounded(tables.read_edge_records(spark, path).select("image_id", "edge_id", "ex", "ey", "mtf", F.size("sfr").alias("n")), "mtf", digits=9)


@register("s11_export_curves_wide", SFR + " select k/64.0e0 f, coalesce(max(case when edge_id = 0 then round(m, 6) end), 0) e0, coalesce(max(case when edge_id = 5 then round(m, 6) end), 0) e5, coalesce(max(case when edge_id = 19 then round(m, 6) end), 0) e19 from s group by 1")
def _s11(spark, d):
    s = rounded(curves.sfr(spark, d), "m").select((F.col("k") / 64.0).alias("f"), F.concat(F.lit("e"), "edge_id").alias("series"), "m")
    return tables.curves_wide(s, ["e0", "e5", "e19"])


@register("s12_write_grid", f"with {reporting._R4} select image_id, direction, round(gx*80*0.004e0, 6) x, round(gy*80*0.004e0, 6) y, round(v, 9) as value from cells")
def _s12(spark, d):
    g = reports.grid_composite(reports.classify_ms(view(spark, d, "v_edges"), 320, 240), 80.0)
    return rounded(rounded(tables.grid_rows(g, 80.0, 0.004), "x", "y"), "value", digits=9)


@register("s13_write_lensprofile", f"with {reporting._R11} select image_id, direction, cast(floor(radius/50) as int) ring, count(*) n, round(avg(mtf), 9) mtf from prof group by 1, 2, 3")
def _s13(spark, d):
    path = shared_path(spark, "lensprofile")
    p = reports.lens_profile(view(spark, d, "v_edges"), 320, 240).withColumn("ring", F.floor(F.col("radius") / 50).cast("int"))
    p.groupBy("image_id", "direction", "ring").agg(F.count("*").alias("n"), F.avg("mtf").alias("mtf")).write.partitionBy("direction").parquet(path)
    return rounded(spark.read.parquet(path), "mtf", digits=9)


@register("s14_write_profile", f"""with {reporting._RM}, w as (select image_id, pos, mtf, list_sort(list(mtf) over (partition by image_id order by pos rows between 2 preceding and 2 following)) a from rm), m as (select *, row_number() over (partition by image_id order by mtf desc, pos) k from rm)
select image_id, 'curve' kind, cast(pos as double) "at", round(mtf, 9) mtf, round(a[len(a)//2 + 1], 9) smooth from w union all select image_id, 'peak', cast(pos as double), round(mtf, 9), null from m where k = 1""")
def _s14(spark, d):
    rm = reports.row_maxima(view(spark, d, "v_edges"))
    smooth = reports.median5(rm, ["image_id"], "at", "mtf").withColumnRenamed("mtf", "smooth")
    top = rm.groupBy("image_id").agg(F.max(F.struct("mtf", (-F.col("at")).alias("na"))).alias("b"))
    peak = top.select("image_id", (-F.col("b.na")).cast("double").alias("at"), F.col("b.mtf").alias("mtf"))
    return rounded(tables.profile_rows(rm, smooth, peak), "mtf", "smooth", digits=9)


@register("s15_write_ca", f"with {reporting._SHIFT} select edge_id, ex, ey, round(red_px, 5) + 0.0e0 red_px, round(blue_px, 5) + 0.0e0 blue_px, round(100*red_px/greatest(1, sqrt(pow(ex - 320, 2) + pow(ey - 240, 2))), 5) + 0.0e0 red_pct, round(100*blue_px/greatest(1, sqrt(pow(ex - 320, 2) + pow(ey - 240, 2))), 5) + 0.0e0 blue_pct from sh join v_edges using (edge_id) where red_px is not null and blue_px is not null")
def _s15(spark, d):
    m = reports.channel_shift(reporting._channel_lsf(spark, d), ["edge_id"]).join(view(spark, d, "v_edges"), "edge_id")
    return rounded(tables.ca_rows(reports.ca_percent(m, 320, 240)), "red_px", "blue_px", "red_pct", "blue_pct", digits=5)


@register("t1_run_corpus", SFR + _MTF + " select edge_id, k, round(mtf50, 6) mtf50 from mtf")
def _t1(spark, d):
    return rounded(arrivals.run_corpus(view(spark, d, "v_samples"), ["edge_id"]), "mtf50")


def expected(spark, d):
    """The closed form of the pictures of v_targets, a dark square with logistic sides of scale s each: 2.1773189849653063 / (2 pi^2 s)."""
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"), (0.35 + (F.col("s_acctbal").cast("double") + 1000) / 20000).alias("s"))
    return s.select("image_id", (2.1773189849653063 / (2 * math.pi**2) / F.col("s")).alias("expected"))


@register("t1_measure_pictures")
def _t1_pictures(spark, d):
    m = measure.measure_pictures(view(spark, d, "v_targets")).join(expected(spark, d), "image_id")
    return rounded(m.select("image_id", "label", "side", "mtf50", "expected", "quality", "reduced_angle", "length", "contaminated"), "mtf50", "expected", "reduced_angle", "length")


@register("q24_measure_windows")
def _q24_windows(spark, d):
    """Windows along the long sides of the pictures of v_targets."""
    m = measure.measure_windows(view(spark, d, "v_targets")).join(expected(spark, d), "image_id")
    return rounded(m.select("image_id", "label", "side", "window", "mtf50", "expected", "quality", "cx", "cy"), "mtf50", "expected", "cx", "cy")


@register("t2_job_status", """select cast(c_custkey as int) image_id, case when c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey % 3 = 0 then 'failed' else 'completed' end status,
  case when c_custkey % 7 = 0 then 'unsupported encoding' when c_custkey % 5 = 0 then 'open failure' when c_custkey % 3 = 0 then 'no targets' end reason from customer""")
def _t2(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("image_id"))
    images = c.withColumn("bit_depth", F.when(F.col("image_id") % 7 == 0, 32).otherwise(8))
    stages = c.where("image_id % 5 <> 0").select("image_id", F.lit(True).alias("opened"), F.when(F.col("image_id") % 3 == 0, 0).otherwise(4).alias("n_objects"))
    return tables.job_status(images, stages)


@register("t3_report_gates", """with c as (select image_id, count(distinct edge_id // 4) blocks, count(*) edges, count(*) filter (mtf < 0.3) vals, sum(edge_id % 9) samples from v_edges group by 1),
g as (select unnest(['profile', 'surface', 'profile_edges', 'map', 'focus', 'ca']) report, unnest([10, 10, 40, 20, 100, 6]) need)
select image_id, report, case report when 'profile_edges' then edges when 'map' then vals when 'focus' then samples else blocks end >= need ok from c, g""")
def _t3(spark, d):
    c = view(spark, d, "v_edges").groupBy("image_id").agg(F.count_distinct(F.expr("edge_id div 4")).alias("blocks"), F.count("*").alias("edges"), F.count_if(F.col("mtf") < 0.3).alias("values"), F.sum(F.col("edge_id") % 9).alias("samples"))
    return tables.report_gates(c)


@register("t4_progress", "select case when c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey % 3 = 0 then 'failed' else 'completed' end status, count(*) n from customer group by 1")
def _t4(spark, d):
    return tables.progress(_t2(spark, d))


@register("t5_follow_arrivals", SFR + _MTF + " select edge_id, k, round(mtf50, 6) mtf50 from mtf")
def _t5(spark, d):
    """The samples arrive as files, a few edges each; what the stream has measured is the batch result."""
    source, log, out = (shared_path(spark, n) for n in ("arrivals", "arrivals-log", "arrivals-out"))
    s = view(spark, d, "v_samples").withColumn("no", F.monotonically_increasing_id())
    s.repartition(4, "edge_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    arrivals.follow_arrivals(spark, source, schema, log, out, ["edge_id"], max_files=2).awaitTermination()
    return rounded(materialise(spark.read.parquet(out).select("edge_id", "k", "mtf50"), "arrivals-done"), "mtf50")


@register("x1_register_strategy", "select edge_id, round(case when quality >= 0.5 then mtf*quality else 0 end, 9) as value from v_edges")
def _x1(spark, d):
    arrivals.register_strategy("value", "weighted", lambda mtf, quality: F.when(quality >= 0.5, mtf * quality).otherwise(0.0))
    e = view(spark, d, "v_edges")
    return rounded(e.select("edge_id", arrivals.strategy("value", "weighted")(F.col("mtf"), F.col("quality")).alias("value")), "value", digits=9)


@register("s5_write_line_deviation", shapes.LINE_DEVIATION_SQL)
def _s5(spark, d):
    path = shared_path(spark, "line-deviation")
    shapes._q22(spark, d).write.parquet(path)
    return spark.read.parquet(path)
