"""Runs over a corpus of captures, at once or as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acutance.operators import esf, spectrum


def run_corpus(samples: DataFrame, keys: list[str], contrast: float = 0.5) -> DataFrame:
    """The measurement of every edge of every capture in one job."""
    curve = esf.pad_missing(esf.bin_triangular(samples, keys), keys)
    response = spectrum.correct(spectrum.dft(esf.lsf(curve, keys), keys))
    return spectrum.mtf_crossing(response, keys, contrast)


def follow_arrivals(spark: SparkSession, source: str, schema, log: str, out: str, keys: list[str], run: Callable[[DataFrame, list[str]], DataFrame] = run_corpus, max_files: int = 100):
    """T5: files that arrive in a folder are measured in micro-batches; a capture's samples are in one file.

    A batch writes to a folder of its own number, so a repeated batch replaces itself. Re-delivered rows of a batch are dropped.
    """

    def measure(batch: DataFrame, number: int) -> None:
        run(batch.dropDuplicates(), keys).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return rows.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(measure).start()


def follow_pictures(spark: SparkSession, source: str, log: str, out: str, max_files: int = 100, **how):
    """T5 from pixels: Parquet files of pixels (image_id, y, x, v) that arrive in a folder; a picture is in one file. Each micro-batch goes through the whole
    measurement (how: see measure_pictures) and writes a folder of its own number, so a repeated batch replaces itself."""
    from acutance.operators.measure import measure_pictures

    return follow_arrivals(spark, source, "image_id int, y int, x int, v double", log, out, ["image_id"], lambda px, _: measure_pictures(px, **how), max_files)


#: User functions by kind and name.
_strategies: dict[tuple[str, str], Callable] = {}


def register_strategy(kind: str, name: str, fn: Callable) -> None:
    """A function of columns for a kind (sampler, esf, warp, value), found again by name."""
    if kind not in {"sampler", "esf", "warp", "value"}:
        raise ValueError(f"no such kind: {kind}")
    _strategies[kind, name] = fn


def strategy(kind: str, name: str) -> Callable:
    return _strategies[kind, name]
