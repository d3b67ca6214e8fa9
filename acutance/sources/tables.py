"""Sources and sinks: pixels, regions and edge records as Parquet, text and CSV tables, all read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCANLINES = T.StructType().add("image_id", "integer").add("channel", "integer").add("y", "integer").add("v", T.ArrayType(T.IntegerType()))
_INTS, _DOUBLES, _ARRAYS = ("image_id", "edge_id"), ("ex", "ey", "angle", "mtf", "quality", "cnr", "oversampling", "ca_red", "ca_blue", "length"), ("sfr", "esf")
EDGE_RECORD = T.StructType([*(T.StructField(n, T.IntegerType()) for n in _INTS), *(T.StructField(n, T.DoubleType()) for n in _DOUBLES), *(T.StructField(n, T.ArrayType(T.FloatType())) for n in _ARRAYS)])


def read_pixels(spark: SparkSession, path: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels of 8- and 16-bit images, of three channels at most, from rows of scan lines; and images that are refused, with reason 5."""
    good = images.where(F.col("bit_depth").isin(8, 16))
    rows = spark.read.schema(SCANLINES).parquet(path).where("channel < 3").join(good.select("image_id"), "image_id", "left_semi")
    px = rows.select("image_id", "channel", "y", F.posexplode("v").alias("x", "v"))
    return px, images.where(~F.col("bit_depth").isin(8, 16)).select("image_id", F.lit(5).alias("reason"))


def scanlines(px: DataFrame) -> DataFrame:
    """Pixels of dense pictures as rows of scan lines, for storage."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda p: p["v"])
    return px.groupBy("image_id", "channel", "y").agg(line.alias("v"))


def parse_rois(lines: DataFrame) -> DataFrame:
    """Lines (value) of four numbers `ax ay bx by`, blanks between them; all other lines are dropped."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    d = lines.withColumn("p", F.transform(parts, lambda s: s.try_cast("double")))
    four = d.where((F.size("p") == 4) & F.forall("p", lambda x: x.isNotNull()))
    return four.select(*[c for c in lines.columns if c != "value"], *[F.col("p")[i].alias(n) for i, n in enumerate(("ax", "ay", "bx", "by"))])


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Regions of text files, keyed by the file's name."""
    return parse_rois(spark.read.text(path).select("value", F.input_file_name().alias("file")))


def measurement_columns(m: DataFrame, version: int) -> DataFrame:
    """S3: columns of the summary of version 1 or 2; version 2 leaves out rows whose first response is 0."""
    cols = ["image_id", "block_id", "ex", "ey", "mtf", "corner_x", "corner_y"]
    if version == 1:
        return m.select(*cols)
    return m.where(F.col("sfr")[0] != 0).select(*cols, "mean_cnr", "oversampling", "length")


def write_measurements(m: DataFrame, path: str, version: int = 2) -> None:
    """S3"""
    measurement_columns(m, version).write.partitionBy("image_id").parquet(path)


def sfr_lines(m: DataFrame, version: int) -> DataFrame:
    """One text line an edge: block, place, angles, in version 2 noise and length, then the response."""
    head = ["block_id", "ex", "ey", "reduced_angle", "radial_angle"] + (["mean_cnr", "oversampling", "length"] if version == 2 else [])
    nums = F.array(*[F.round(F.col(c).cast("double"), 4) for c in head])
    both = F.concat(nums, F.transform("sfr", lambda x: F.round(x.cast("double"), 4)))
    return m.select("image_id", F.concat_ws(" ", F.transform(both, lambda x: F.format_string("%.4f", x))).alias("value"))


def write_sfr(m: DataFrame, path: str, version: int = 2) -> None:
    """S4"""
    sfr_lines(m, version).write.partitionBy("image_id").text(path)


def raw_mtf(m: DataFrame, angle: float | None = None, tol: float = 5.0) -> DataFrame:
    """A row for each block with its edges' values in order, only edges within tol degrees of an angle modulo 180 if one is given."""
    if angle is not None:
        off = F.abs(F.pmod(F.col("angle") - angle + 90, F.lit(180.0)) - 90)
        m = m.where(off <= tol)
    v = F.transform(F.sort_array(F.collect_list(F.struct("k", "mtf"))), lambda e: e["mtf"])
    return m.groupBy("image_id", "block_id").agg(v.alias("mtfs"))


def pack_curve(curve: DataFrame, keys: list[str], at: str, value: str, to: str) -> DataFrame:
    """The points of a curve as one array, in order."""
    return curve.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda e: e[value]).alias(to))


def edge_records(m: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full edge records, and a header for each image with the number of valid edges."""
    head = images.join(m.groupBy("image_id").agg(F.count_if(F.col("mtf").isNotNull()).alias("n_edges")), "image_id", "left").fillna(0, ["n_edges"])
    return m.select(*[F.col(f.name).cast(f.dataType) if f.name in m.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EDGE_RECORD.fields]), head


def read_edge_records(spark: SparkSession, path: str, most: int = 128) -> DataFrame:
    """Stored records; those with a response of more than 128 samples are refused."""
    return spark.read.schema(EDGE_RECORD).parquet(path).where(F.size("sfr") <= most)


def curves_wide(sfr: DataFrame, series: list[str]) -> DataFrame:
    """A row for each frequency and a column for each named series; 0 where there is nothing."""
    return sfr.groupBy("f").pivot("series", series).agg(F.first("m")).fillna(0.0)


def grid_rows(grid: DataFrame, cell: float, unit: float = 1.0) -> DataFrame:
    """Cells as x, y (pixels, or mm if unit is the size of a pixel) and value."""
    return grid.select("image_id", "direction", (F.col("gx") * cell * unit).alias("x"), (F.col("gy") * cell * unit).alias("y"), F.col("v").alias("value"))


def profile_rows(curve: DataFrame, smooth: DataFrame, peak: DataFrame) -> DataFrame:
    """Place, raw maximum and smoothed value of the profile, then the peak's row."""
    rows = curve.join(smooth, ["image_id", "at"]).select("image_id", F.lit("curve").alias("kind"), F.col("at").cast("double").alias("at"), "mtf", "smooth")
    return rows.unionByName(peak.select("image_id", F.lit("peak").alias("kind"), "at", "mtf", F.lit(None).cast("double").alias("smooth")))


def ca_rows(m: DataFrame) -> DataFrame:
    """Shifts in pixels and per cent; edges without a value are left out."""
    return m.where(F.col("red_px").isNotNull() & F.col("blue_px").isNotNull()).select("edge_id", "ex", "ey", "red_px", "blue_px", "red_pct", "blue_pct")


def job_status(images: DataFrame, stages: DataFrame) -> DataFrame:
    """For each image, done or failed and why; stages: image_id, opened, n_objects."""
    j = images.join(stages, "image_id", "left")
    why = F.when(~F.col("bit_depth").isin(8, 16), "unsupported encoding").when(F.col("opened").isNull() | ~F.col("opened"), "open failure").when(F.col("n_objects") == 0, "no targets")
    return j.select("image_id", F.when(why.isNull(), "completed").otherwise("failed").alias("status"), why.alias("reason"))


#: What each report needs at least, and of which count.
GATES = [("profile", "blocks", 10), ("surface", "blocks", 10), ("profile_edges", "edges", 40), ("map", "values", 20), ("focus", "samples", 100), ("ca", "blocks", 6)]


def report_gates(counts: DataFrame) -> DataFrame:
    """Which reports an image has enough for; counts: image_id, blocks, edges, values, samples."""
    rules = F.array(*[F.struct(F.lit(r).alias("report"), F.col(c).alias("have"), F.lit(n).alias("need")) for r, c, n in GATES])
    return counts.select("image_id", F.explode(rules).alias("g")).select("image_id", "g.report", (F.col("g.have") >= F.col("g.need")).alias("ok"))


def progress(status: DataFrame) -> DataFrame:
    """T4: jobs by status; on a stream with complete output, running counts."""
    return status.groupBy("status").agg(F.count("*").alias("n"))
