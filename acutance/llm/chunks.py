"""Chunks: documents packed into rows of a few MB, and questions that chunks put to shards of all chunks' keys.

Counting over a corpus and looking the counts up again goes through one exchange: each chunk sends its distinct keys to the
shards they hash to, a shard answers every chunk in the order of its keys, and the answers meet the chunk again by its id.
A key is in a shard's input once for each chunk that has it, however often it occurs, so a frequent key is no burden.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.common import text_slices, tidy, trim
from acutance.session import materialise, shared_path, ship_package

ANSWER = "chunk long, shard long, answer binary"
#: Stands for the chunk of a shard's own sums.
SUMS = -1


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        name = a.dtype.str.encode()
        parts += [len(name).to_bytes(1, "little"), name, len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(value: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(value), [], 2
    for _ in range(int.from_bytes(raw[:2], "little")):
        n = raw[at]
        dtype = np.dtype(raw[at + 1 : at + 1 + n].decode())
        size = int.from_bytes(raw[at + 1 + n : at + 9 + n], "little")
        at += 9 + n
        out.append(np.frombuffer(raw, dtype, size // dtype.itemsize, at))
        at += size
    return out


def make_chunks(docs: DataFrame, key: str, text: str, chunk_bytes: int, name: str) -> DataFrame:
    """(chunk, keys, body): the written table of chunks; body holds the texts' bytes and their offsets. A document is in one chunk."""
    ship_package(docs.sparkSession)
    schema = T.StructType().add("chunk", "long").add("keys", T.ArrayType(docs.schema[key].dataType)).add("bytes", "long").add("body", "binary")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        keys, parts, lengths, size = [], [], [], 0

        def flush():
            nonlocal keys, parts, lengths, size, number
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int64)
            body = squeeze(np.concatenate(parts), offsets)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([keys]), pa.array([size], pa.int64()), pa.array([body], pa.binary())], schema.names)
            number += 1
            keys, parts, lengths, size = [], [], [], 0
            return out

        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text), chunk_bytes):
                if size and size + len(data) > chunk_bytes:
                    yield flush()
                keys += batch.column(key)[lo:hi].to_pylist()
                parts.append(data.copy())
                lengths.append(np.diff(offsets))
                size += len(data)
        if keys:
            yield flush()

    path = shared_path(docs.sparkSession, name)
    docs.select(key, text).mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def ask(chunks: DataFrame, request: Callable, answer: Callable, name: str, fields: list[str], to: str = "answers") -> DataFrame:
    """chunks with a column of answers, an array of (shard, answer).

    request(row) gives (shard, payload) pairs for a chunk, row a dict of the fields; answer(payloads) gives an answer for
    each payload of a shard. Both sides of the exchange are bounded: a chunk's keys, and the keys of a shard. A chunk sends
    nothing to shards for which it has no key, so there are never more payloads than keys.
    """
    return _ask(chunks, request, answer, name, fields, to)[0]


def ask_with_sums(chunks: DataFrame, request: Callable, answer: Callable, name: str, fields: list[str], to: str = "answers") -> tuple[DataFrame, DataFrame]:
    """Like ask; answer(payloads) also gives a shard's own sums as one more answer. The second table holds these (shard, answer)."""
    return _ask(chunks, request, answer, name, fields, to)


def _ask(chunks: DataFrame, request: Callable, answer: Callable, name: str, fields: list[str], to: str) -> tuple[DataFrame, DataFrame]:

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {f: batch.column(f)[row].as_py() for f in fields}
                shards, payloads = [], []
                for shard, payload in request(one):
                    shards.append(shard)
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([pa.array([one["chunk"]] * len(shards), pa.int64()), pa.array(shards, pa.int64()), pa.array(payloads, pa.binary())], ["chunk", "shard", "payload"])

    def reply(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        answers = answer([x.as_py() for x in group["payload"]])
        trim()
        own = len(answers) - len(group)  # 1 with the shard's sums, else 0
        at = np.concatenate((group["chunk"].to_numpy(), [SUMS] * own)).astype(np.int64)
        return pa.table({"chunk": at, "shard": pa.array([group["shard"][0].as_py()] * len(answers), pa.int64()), "answer": pa.array(answers, pa.binary())})

    sent = chunks.select(*fields).mapInArrow(send, "chunk long, shard long, payload binary")
    answers = materialise(sent.groupBy("shard").applyInArrow(reply, ANSWER), name)
    packed = answers.where(F.col("chunk") != SUMS).groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(to))  # as many as shards
    return chunks.join(packed, "chunk", "left"), answers.where(F.col("chunk") == SUMS).select("shard", "answer")


def dealt(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """The indices of each shard, in their order."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))
