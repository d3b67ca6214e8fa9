"""Exact dedup (operator 4): stateful streaming over digests, with a check of full bytes on hits.

Each text is normalised (its separators are deleted) and digested once. The digests stream, in batches of a bounded size,
through a keyed aggregate whose state is on disk (RocksDB) and never expires: for a digest it holds how many rows came,
and the stable identifier, length and content locator (file and row number) of the row that stays. An update in a later batch
replaces what an earlier one wrote. With a state folder given by the caller, index, state and results last: a later call with
more documents adds them to the index, and the stream goes on where it ended, against all documents so far.

A digest with more than one row is a hit. Hits alone are read again, and their full normalised texts are grouped: rows
stay in one group only if all bytes agree, so a collision of digests splits the group. Equal texts are summed up in each
task before they are shuffled; one text with a third of all rows is no more work than others.

A null text counts as empty. Of equal texts the one with most code points stays, then the smallest key (a null key
last), then the smallest locator: of rows that repeat key and text, one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acutance.llm.common import SPACES, keep_matching, located
from acutance.session import materialise, shared_path

#: The state is on disk; its memory is bounded for the executor as a whole, and a store is closed when its task commits.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: A batch of the stream is an eighth of the index's files, but this many bytes at least.
BATCH_BYTES, BATCHES = 8 << 20, 8


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def index_rows(docs: DataFrame, at: str, key: str, text: str, digest=sha256) -> DataFrame:
    """A narrow row for each document: key, digest, code points of the original, and where its content is."""
    return docs.select(F.col(key).alias("key"), digest(normalised(text)).alias("digest"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"), F.col(at).alias("locator"))


def _rank() -> Column:
    """Least is best: most code points, then the smallest key, nulls last, then the locator."""
    return F.struct((-F.col("points")).alias("points"), F.col("key").isNull().alias("no_key"), F.col("key"), F.col("locator"))


def stream_state(index: DataFrame, folder: str, max_bytes: int) -> DataFrame:
    """(digest, n, best) after all rows of the index have gone through the stream; folder holds index, state and results of all runs."""
    spark = index.sparkSession
    out = f"{folder}/groups"
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    try:
        rows = spark.readStream.schema(index.schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(f"{folder}/index")
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(_rank()).alias("best"))
        state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if index.isEmpty():
        return spark.createDataFrame([], state.schema)
    saved = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(out)
    return saved.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("best", "n").alias("best"))


def _groups(docs: DataFrame, at: str, key: str, text: str, digest, max_bytes: int | None, folder: str | None) -> DataFrame:
    """A row for each document so far: key, locator, keep_key, group_size, kept, digest."""
    spark = docs.sparkSession
    lasting, folder = folder is not None, (folder or shared_path(spark, "dedup")).rstrip("/")
    new = index_rows(docs, at, key, text, digest)
    if lasting and _exists(spark, f"{folder}/index"):  # rows that came before, in a call that failed or was repeated, are in the index once
        new = new.join(spark.read.schema(new.schema).parquet(f"{folder}/index").select("locator"), "locator", "left_anti").select(*new.columns)
    new.write.mode("append").parquet(f"{folder}/index")
    index = spark.read.schema(new.schema).parquet(f"{folder}/index")
    if max_bytes is None:
        max_bytes = max(BATCH_BYTES, sum(f.length for f in _files(spark, f"{folder}/index")) // BATCHES)
    state = materialise(stream_state(index, folder, max_bytes), "dedup-groups")
    hits = state.where("n > 1").select("digest")
    if lasting:  # texts of earlier runs are where their locators say
        docs, at = _stored(spark, index, docs, key, text)
    full = docs.select(F.col(at).alias("locator"), F.col(key).alias("key"), normalised(text).alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points")).withColumn("digest", digest(F.col("norm")))
    full = keep_matching(full, hits, ["digest"], "left_semi")
    # All bytes of the texts are the key here; the aggregate before the shuffle leaves one row for each text and task.
    texts = full.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    checked = materialise(texts.select("digest", "n"), "dedup-checked")
    several = materialise(checked.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-collisions")
    sure = keep_matching(state, several, ["digest"], "left_anti")
    rows = index.join(sure, "digest").select("key", "locator", F.col("best.key").alias("keep_key"), F.col("n").alias("group_size"), (F.col("locator") == F.col("best.locator")).alias("kept"), "digest")
    if several.isEmpty():
        return rows
    # The rows of digests that stand for several texts are grouped by the texts.
    full = materialise(keep_matching(full, several, ["digest"], "left_semi"), "dedup-split")
    groups = full.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.min(_rank()).alias("best"))
    split = full.join(groups, ["digest", "norm"])
    return rows.unionByName(split.select("key", "locator", F.col("best.key").alias("keep_key"), F.col("n").alias("group_size"), (F.col("locator") == F.col("best.locator")).alias("kept"), "digest"))


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _files(spark, path: str) -> list:
    """The data files of a folder, as Spark lists them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("length").collect()


def _stored(spark, index: DataFrame, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """The documents of all runs, read from the files that the index names."""
    files = [r["file"] for r in index.select("locator.file").distinct().collect()]  # as many as files
    return located(spark.read.schema(docs.select(key, text).schema).parquet(*files)) if files else located(docs)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, max_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """A row for each document: key, keep_key, group_size, kept, digest.

    folder: where index and state last. A call with a folder that was used before adds docs (rows of new Parquet files) and
    gives the rows of all documents so far; the files of earlier calls must still be there, as hits are compared in full. One
    call at a time may use a folder. A row is told by its file and row number, so a file that is delivered again, or a call
    that is repeated after it failed, adds nothing twice.
    """
    docs, at = located(docs)
    return _groups(docs, at, key, text, digest, max_bytes, folder).drop("locator")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text another row holds: one row of each text stays, whatever keys repeat or are null."""
    rows, at = located(docs)
    found = _groups(rows, at, key, text, options.get("digest", sha256), options.get("max_bytes"), None)
    drop = materialise(found.where("not kept").select(F.col("locator").alias(at)), "dedup-dropped")
    return keep_matching(rows, drop, [at], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
