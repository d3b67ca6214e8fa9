"""From the line-spread function to the frequency response (SFR) and the measurement of each edge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from acutance.session import ship_package

BINS, FREQS = 512, 64


def twiddles(spark: SparkSession, bins: int = BINS, freqs: int = FREQS) -> DataFrame:
    """cos and sin of each (bin, k): a table of fixed size, bins * freqs rows."""
    a = F.lit(-2 * math.pi / bins) * ((F.col("bin") * F.col("k")) % bins)
    t = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(freqs - 1))))
    return t.select("bin", "k", F.cos(a).alias("c"), F.sin(a).alias("s"))


def dft(lsf: DataFrame, keys: list[str], bins: int = BINS, freqs: int = FREQS, at: str = "bin", parts: bool = False) -> DataFrame:
    """magnitude of the DFT relative to k = 0, null where that is 0; with parts also re and im.

    A curve is packed into one row, its bins at most, and curves are transformed a batch at a time: nothing is multiplied
    out to bins x freqs rows. Bins of one number add up; a curve without a value other than 0 has no rows.
    """
    ship_package(lsf.sparkSession)
    packed = lsf.where("v <> 0").groupBy(*keys).agg(F.collect_list(F.col(at).cast("int")).alias("_bins"), F.collect_list(F.col("v").cast("double")).alias("_v"))
    schema = T.StructType([packed.schema[k] for k in keys]).add("k", "integer").add("m", "double")
    if parts:
        schema = schema.add("re", "double").add("im", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own, values = batch.column("_bins"), batch.column("_v")
            curves = np.zeros((n, bins))
            np.add.at(curves, (np.repeat(np.arange(n), own.value_lengths().to_numpy()), own.flatten().to_numpy() % bins), values.flatten().to_numpy())
            spectra = np.fft.fft(curves, axis=1)[:, :freqs]
            mag = np.abs(spectra)
            m = mag / np.where(mag[:, :1] > 0, mag[:, :1], np.nan)
            rows = pa.array(np.repeat(np.arange(n), freqs))
            more = [pa.array(spectra.real.ravel()), pa.array(spectra.imag.ravel())] if parts else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.array(np.tile(np.arange(freqs, dtype=np.int32), n)), pa.array(m.ravel(), from_pandas=True), *more], schema.names)

    return packed.mapInArrow(run, schema)


def sinc_correction(k, per_pixel: int = 8):
    """response of the central difference, sin(x) / x with x = 2 pi k / 64 / per_pixel."""
    x = F.lit(2 * math.pi / 64 / per_pixel) * k
    return F.when(k == 0, 1.0).otherwise(F.sin(x) / x)


def correct(sfr: DataFrame) -> DataFrame:
    """the response divided by that of the derivative."""
    return sfr.withColumn("m", F.col("m") / sinc_correction(F.col("k")))


def mtf_crossing(sfr: DataFrame, keys: list[str], contrast: float = 0.5) -> DataFrame:
    """the frequency (cycles a pixel) of the first k below 64 at which the response falls to the contrast, interpolated."""
    w = W.partitionBy(*keys).orderBy("k")
    steps = sfr.withColumn("before", F.lag("m").over(w)).where((F.col("k") < 64) & (F.col("before") > contrast) & (F.col("m") <= contrast))
    x = F.col("k") - 1 + (F.col("before") - contrast) / (F.col("before") - F.col("m"))
    first = steps.groupBy(*keys).agg(F.min(F.struct("k", (x / 64.0).alias("f"))).alias("s"))
    return sfr.select(*keys).distinct().join(first, keys, "left").select(*keys, F.col("s.k").alias("k"), F.col("s.f").alias("mtf50"))


def not_available(m: DataFrame, min_angle: float = 0.1) -> DataFrame:
    """no value for edges without a crossing or with a reduced angle below min_angle degrees, and a flag."""
    ok = F.col("mtf50").isNotNull() & (F.col("reduced_angle") >= min_angle)
    return m.withColumn("valid", ok).withColumn("mtf50", F.when(ok, F.col("mtf50")))


def edge_quality(angle, length, contaminated, usable):
    """1; 0.5 near 0 and 45 degrees; 0.8 near 26.565; halved below 25 pixels; 0.2 if contaminated; 0 if unusable. Later rules win."""
    q = F.when((angle <= 1) | (angle >= 44), 0.5).when(F.abs(angle - 26.565) < 1, 0.8).otherwise(1.0)
    q = F.when(length < 25, q * 0.5).otherwise(q)
    q = F.when(contaminated, 0.2).otherwise(q)
    return F.when(usable, q).otherwise(0.0)


def accept_edges(m: DataFrame, block: list[str], most: float = 1.2) -> DataFrame:
    """edges of at most this value, of blocks that have an edge above zero."""
    any_value = F.max((F.col("mtf") > 1e-6).cast("int")).over(W.partitionBy(*block))
    return m.withColumn("_any", any_value).where((F.col("mtf") <= most) & (F.col("_any") == 1)).drop("_any")


def to_lpmm(m: DataFrame, images: DataFrame, value: str = "mtf") -> DataFrame:
    """line pairs a mm: cycles a pixel times 1000 / pixel size in micrometres."""
    return m.join(images.select("image_id", "pixel_um"), "image_id").withColumn("lpmm", F.col(value) * 1000 / F.col("pixel_um"))


def upsample(sfr: DataFrame, keys: list[str], steps: int = 20) -> DataFrame:
    """a cubic through four neighbours, steps points a step; the ends repeat their slope."""
    w = W.partitionBy(*keys).orderBy("k")
    a, d = F.lag("m").over(w), F.lead("m", 2).over(w)
    rows = sfr.select(*keys, "k", F.col("m").alias("p1"), F.lead("m").over(w).alias("p2"), a.alias("p0"), d.alias("p3")).where("p2 is not null")
    rows = rows.withColumn("p0", F.coalesce("p0", 2 * F.col("p1") - F.col("p2"))).withColumn("p3", F.coalesce("p3", 2 * F.col("p2") - F.col("p1")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("t", F.col("step") / float(steps))
    cubic = "p1 + 0.5D*t*(p2 - p0 + t*(2*p0 - 5*p1 + 4*p2 - p3 + t*(3*(p1 - p2) + p3 - p0)))"
    return rows.select(*keys, ((F.col("k") + F.col("t")) / 64.0).alias("f"), F.expr(cubic).alias("m"))


def contrast_at(sfr: DataFrame, keys: list[str], freq: float) -> DataFrame:
    """the response at a frequency, linear between samples, the index at most 62."""
    x = min(freq * 64, 63.0)
    i = min(int(x), 62)
    rows = sfr.where(F.col("k").isin(i, i + 1)).groupBy(*keys).agg(F.max(F.when(F.col("k") == i, F.col("m"))).alias("a"), F.max(F.when(F.col("k") == i + 1, F.col("m"))).alias("b"))
    return rows.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (x - i)).alias("contrast"))


def contrast_step_at(sfr: DataFrame, keys: list[str], freq: float) -> DataFrame:
    """F16: the last sample strictly before the frequency, or else the first."""
    before = F.col("k") / 64.0 < freq
    return sfr.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(before, F.col("m")), F.when(before, F.col("k"))), F.min_by("m", "k")).alias("contrast"))


def quality_flags(m: DataFrame) -> DataFrame:
    """yellow and red flags by noise, angle, oversampling and length."""
    a = F.col("reduced_angle")
    near = lambda tol: (a < tol) | (a > 45 - tol) | (F.abs(a - 26.565) < tol)
    level = lambda red, yellow: F.when(red, "red").when(yellow, "yellow").otherwise("ok")
    return m.withColumns({
        "cnr_flag": level(F.col("cnr") < 20, F.col("cnr") < 30), "angle_flag": level(near(1.0), near(2.0)),
        "oversampling_flag": level(F.col("oversampling") <= 4, F.col("oversampling") < 8), "length_flag": level(F.col("length") <= 25, F.col("length") > 400)})


def kernel_correction(alpha: float = 13.0, freqs: int = 128) -> list[float]:
    """magnitude of the spectrum of the smoothing kernel, cut at 0.625 pixels, relative to its sum, for k / 64 cycles a pixel."""
    def value(x: float) -> float:
        c = 1 / 16
        norm = 1 - math.exp(-alpha * c)
        return (2 - 2 * math.exp(-alpha * c) * math.cosh(alpha * x)) / (2 * math.sinh(alpha * c) * norm) if abs(x) < c else math.exp(-alpha * abs(x)) / norm

    xs = [i / 128 for i in range(-80, 81)]
    ws = [value(x) for x in xs]
    return [abs(sum(w * math.cos(2 * math.pi * k / 64 * x) for w, x in zip(ws, xs))) / sum(ws) for k in range(freqs)]


def correct_kernel(sfr: DataFrame, alpha: float = 13.0) -> DataFrame:
    """F6 with F3: the response divided by those of the derivative and of the kernel."""
    table = F.array(*[F.lit(x) for x in kernel_correction(alpha)])
    return sfr.withColumn("m", F.col("m") / sinc_correction(F.col("k")) / F.element_at(table, F.col("k") + 1))


def unbounce(sp: DataFrame, keys: list[str]) -> DataFrame:
    """the sign of each magnitude: it flips where the phase jumps by over 90 degrees within two steps below half the response, never twice in a row.

    sp: keys, k, re, im, m (relative to k = 0). The curve is packed, and one aggregate carries the last phases.
    """
    packed = sp.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "re", "im", "m"))).alias("a"))
    step = """aggregate(a, named_struct('p0', 0D, 'p1', 0D, 'sign', 1D, 'last', -1, 'turn', -1D, 'out', cast(array() as array<double>)), (s, e) -> if(e.k = 0 or e.k > {top},
      named_struct('p0', s.p0, 'p1', s.p1, 'sign', s.sign, 'last', s.last, 'turn', s.turn, 'out', array_append(s.out, e.m)),
      transform(array(if(e.m > 1e-4D, atan2(e.im * s.turn, e.re * s.turn), cast(null as double))), raw ->
        transform(array(coalesce(raw - 2 * pi() * rint((raw - s.p1) / (2 * pi())), 0D)), p ->
          transform(array(e.k > 3 and abs(p - s.p0) > pi() / 2 and s.last < e.k - 1 and e.m < 0.5D), jump ->
            named_struct('p0', s.p1, 'p1', p, 'sign', if(jump, -s.sign, s.sign), 'last', if(jump, e.k, s.last), 'turn', -s.turn,
              'out', array_append(s.out, e.m * if(jump, -s.sign, s.sign))))[0])[0])[0])).out"""
    top = packed.withColumn("o", F.expr(step.format(top="a[size(a) - 1].k - 1")))
    return top.select(*keys, F.posexplode("o").alias("k", "m"))


def smoothing_weights(half: int) -> list[float]:
    """Weights of the parabola through 2 half + 1 equally spaced points, at the middle one."""
    d = (2 * half - 1) * (2 * half + 1) * (2 * half + 3)
    return [3 * (3 * half * half + 3 * half - 1 - 5 * x * x) / d for x in range(-half, half + 1)]


def smooth_sfr(sp: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """a 5-tap pass with the low end mirrored, then passes of parabolas that widen with k (half widths 2 to 7); each pass relative to k = 0; then sizes.

    The curve is packed to an array of fixed length, and a pass is one transform of it.
    """
    packed = sp.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("a"))
    n = F.size("a")
    five = (-0.086, 0.343, 0.486, 0.343, -0.086)
    first = lambda m, i: F.when(i < n - 3, sum((F.col("a")[F.abs(i + x)] * five[x + 2] for x in range(-2, 3)), F.lit(0.0))).otherwise(m)
    packed = packed.withColumn("a", F.transform("a", first))
    weights = F.array(*[F.array(*[F.lit(([0.0] * (7 - h) + smoothing_weights(h) + [0.0] * (7 - h))[x]) for x in range(15)]) for h in range(2, 8)])
    packed = packed.withColumn("w", weights)

    def wide(m, i):
        order = F.least(F.lit(5), F.floor((i - 5) / 3)).cast("int")
        total = sum((F.col("a")[i + x] * F.col("w")[order][x + 7] for x in range(-7, 8)), F.lit(0.0))
        return F.when((i < 7) | (i >= n - 9), m).otherwise(total)

    for _ in range(passes):
        packed = packed.withColumn("a", F.transform("a", wide)).withColumn("a", F.transform("a", lambda m: m / F.col("a")[0]))
    return packed.select(*keys, F.posexplode(F.transform("a", lambda m: F.abs(m))).alias("k", "m"))


def refine_crossing(sfr: DataFrame, crossing: DataFrame, keys: list[str], contrast: float = 0.5) -> DataFrame:
    """F8: the crossing by a least-squares parabola of the index on the response, half width 2 to 9; below k = 10 the linear value stays in effect."""
    from acutance.operators.geometry import cramer3

    c = crossing.where("k >= 5 and k < 118").select(*keys, F.col("k").alias("k0"), F.col("mtf50").alias("linear"), F.least(F.greatest(F.lit(2), F.col("k") - 9), F.lit(9)).alias("h"))
    near = sfr.join(c, keys).where(F.abs(F.col("k") - F.col("k0")) <= F.col("h"))
    y, x = F.col("m"), (F.col("k") - F.col("k0")).cast("double")
    sums = near.groupBy(*keys, "k0", "linear").agg(*[F.sum(F.pow(y, float(i))).alias(f"s{i}") for i in range(5)], *[F.sum(F.pow(y, float(i)) * x).alias(f"t{i}") for i in range(3)])
    a, b, d = cramer3([F.col(f"s{i}") for i in range(5)], [F.col(f"t{i}") for i in range(3)])
    mid = (a * contrast * contrast + b * contrast + d + F.col("k0")) / 64
    w = F.when(F.col("k0") > 9, 1.0).otherwise((F.col("k0") - 5) / 512.0 / 8)
    fine = sums.select(*keys, ((1 - w) * F.col("linear") + w * mid).alias("fine"))
    return crossing.join(fine, keys, "left").select(*keys, F.coalesce("fine", "mtf50").alias("mtf50"))
