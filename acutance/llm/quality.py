"""Quality classifier (operator 2): hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features of a text are hashed word n-grams over two views of its words: the lower-cased word itself and its shape
(letter case, digits, number and kind of symbols, length class, and whether it repeats the word before). Each view
gives unigrams and bigrams; a feature's value is its share of the text's n-grams, so long texts weigh no more than
short ones. A score is the logistic function of the sparse dot product of these values with the weights plus a bias.

Training reads labelled rows only. Above max_train of them, it takes those with the lowest hash of their id, a bounded
sample. Shards of shard_rows rows are trained side by side, each with its own leader, and their weights are averaged
after every round (iterative parameter mixing), so no task grows with the input.

Null and empty texts have no n-grams and get the bias alone. Rows with a null label or id teach nothing; repeated rows
are scored each; without any label all scores are 0.5. Existing columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.common import RollingHash, lower_ascii, mix64, text_slices, tidy, word_bounds
from acutance.session import materialise, ship_package

BITS = 18
SCALE = 8.0


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and value of every n-gram occurrence of the rows of a slice."""
    lower = lower_ascii(data)
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), rows, np.zeros(0)
    words = RollingHash(lower).of(starts, ends)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[ends] - sums[starts]

    n = ends - starts
    upper = count((data >= 65) & (data <= 90))
    low = count((data >= 97) & (data <= 122))
    digits = count((data >= 48) & (data <= 57))
    wide = count(data >= 128)
    symbols = n - upper - low - digits - wide
    again = np.zeros(len(n), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    kind = np.where(upper == 0, 0, np.where(upper + wide + symbols + digits == n, np.where(n - symbols > 1, 3, 2), 1))
    last = np.where(symbols > 0, data[ends - 1], 0).astype(np.int64)
    shape = (((kind * 3 + np.minimum(digits, 2)) * 5 + np.minimum(symbols, 4)) * 256 + last) * 4 + np.minimum(n // 6, 3)
    shape = mix64((shape * 2 + again).astype(np.uint64) + np.uint64(1 << 40))
    mask = np.uint64((1 << bits) - 1)
    pair = rows[1:] == rows[:-1]

    def bigram(x: np.ndarray, salt: int) -> np.ndarray:
        return mix64(x[:-1] * np.uint64(31) + mix64(x[1:] + np.uint64(salt)))[pair]

    parts = [(mix64(words + np.uint64(1)), rows), (bigram(words, 2), rows[1:][pair]), (shape, rows), (bigram(shape, 3), rows[1:][pair])]
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    value = [SCALE / np.maximum(per_row[r] - (k in (1, 3)), 1) for k, (_, r) in enumerate(parts)]
    return np.concatenate([(h & mask).astype(np.int64) for h, _ in parts]), np.concatenate([r for _, r in parts]), np.concatenate(value)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_rows(spark_rows: DataFrame, text: str, bits: int) -> DataFrame:
    """Rows (shard, y, buckets, values) of labelled texts: the sparse vectors, summed by bucket."""
    schema = T.StructType().add("shard", "integer").add("h", "long").add("y", "double").add("buckets", "binary").add("vals", "binary")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, v = [], []
            for _, _, data, offsets in text_slices(batch.column(text)):
                bucket, row, value = features(data, offsets, bits)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    part = order[cuts[i] : cuts[i + 1]]
                    keys, back = np.unique(bucket[part], return_inverse=True)
                    b.append(keys.astype(np.int32).tobytes())
                    v.append(np.bincount(back, weights=value[part], minlength=len(keys)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("h"), batch.column("y"), pa.array(b, pa.binary()), pa.array(v, pa.binary())], schema.names)

    return spark_rows.mapInArrow(run, schema)


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", bits: int = BITS, max_train: int = 20_000,
          shard_rows: int = 2_500, rounds: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """The weights (2^bits of them, then the bias) learnt from labelled rows."""
    spark = labelled.sparkSession
    ship_package(spark)
    size = 1 << bits
    rows = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"), (F.col(label) > 0).cast("double").alias("y"), F.col(text).alias(text))
    n = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).count()
    if not n:
        return np.zeros(size + 1)
    if n > max_train:
        rows = rows.where(F.col("h") <= int(-(1 << 63) + (1 << 64) * max_train / n))
    shards = max(1, min(n, max_train) // shard_rows)
    rows = rows.withColumn("shard", F.pmod(F.hash("h"), F.lit(shards)))
    vectors = materialise(train_rows(rows, text, bits), "quality")

    def fit(weights: np.ndarray, seed: int):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("h", "ascending"), ("y", "ascending")])
            y = group["y"].to_numpy()
            keys = [np.frombuffer(x.as_py(), np.int32) for x in group["buckets"]]
            values = [np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in group["vals"]]
            z, g2 = np.zeros(size + 1), np.zeros(size + 1)
            z[:] = -weights * (beta / alpha + l2) - np.sign(weights) * l1
            for i in np.random.default_rng(seed).permutation(len(y)):
                k, x = np.append(keys[i], size), np.append(values[i], 1.0)
                zk, nk = z[k], g2[k]
                root = np.sqrt(nk)
                w = np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + root) / alpha + l2))
                g = (_logistic(np.array([w @ x]))[0] - y[i]) * x
                z[k] += g - (np.sqrt(nk + g * g) - root) / alpha * w
                g2[k] = nk + g * g
            w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))
            at = np.flatnonzero(w)
            return pa.table({"k": pa.array(at.astype(np.int32)), "w": pa.array(w[at] * len(y))})

        return run

    weights, total = np.zeros(size + 1), vectors.count()
    for r in range(rounds):
        parts = vectors.groupBy("shard").applyInArrow(fit(weights, r), "k int, w double")
        mixed = parts.groupBy("k").agg((F.sum("w") / F.lit(max(total, 1))).alias("w")).toPandas()
        weights = np.zeros(size + 1)
        weights[mixed["k"].to_numpy()] = mixed["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with score and predicted. The weights are 2^bits numbers, whatever the input's size."""
    spark = docs.sparkSession
    ship_package(spark)
    bits = int(len(weights) - 1).bit_length() - 1
    sent = spark.sparkContext.broadcast(weights.astype(np.float64))
    fields = [f for f in docs.schema.fields if f.name not in {"score", "predicted"}]
    kept = [f.name for f in fields]
    schema = T.StructType(list(fields)).add("score", "double").add("predicted", "integer")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            z = np.full(batch.num_rows, w[-1])
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                bucket, row, value = features(data, offsets, bits)
                z[lo:hi] += np.bincount(row, weights=w[bucket] * value, minlength=hi - lo)
            p = _logistic(z)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def train_from_labels(docs: DataFrame, labels: DataFrame, **options) -> np.ndarray:
    """Weights from docs joined with labels(doc_id, quality), rows of remainder 1 left out."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 3) != 1)
    limit = options.get("max_train", 20_000)
    n = known.count()
    if n > limit:  # sample before texts are joined, so that their shuffle is bounded too
        known = known.where(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")) <= int(-(1 << 63) + (1 << 64) * limit / n))
    return train(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), **options)


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    return score(docs, weights).where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
