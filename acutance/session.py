"""Session settings and the places where intermediate tables live."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, and the most rows of a table that is broadcast.
BATCH_ROWS, BROADCAST_ROWS = 1_000, 100_000


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that every job here assumes."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if the master is this process alone; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the table: later reads survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    had = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, had)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Inside, Spark deletes the shuffle files of a query when it ends; else they stay until the driver's JVM happens to collect garbage. For frames that run once."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def broadcasts_counted(spark: SparkSession) -> Iterator[None]:
    """Inside, only tables with a hint (broadcast_if_small) are broadcast. Spark sizes a table by the compressed bytes of its files, and rows after an explode like those
    before it: millions of pixels in files of 1 MB would be broadcast. For frames that run inside."""
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), _setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"):
        yield


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast in a join if a count finds at most that many rows; a larger one is left to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it wherever they run.

    Batches to them are made of fewer rows than by default, as rows may hold long texts.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_acutance_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "acutance_pkg.zip")
    Path(path).write_bytes(out.getvalue())
    sc.addPyFile(path)
    sc._acutance_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
