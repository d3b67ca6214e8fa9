"""Repeated substrings (operator 8): a difference-cover sample, then one bucket of suffixes sorted at a time.

A byte is removed if a string of span bytes that covers it starts anywhere else too. Positions of a document whose
remainder modulo v is in the difference cover D are the sample: for any two positions i and j there is an offset below v
at which both are in the sample. So if the strings of span bytes at i and j are equal, there are two sample positions, at
the same offset from i and j, whose strings of span - v + 1 bytes are equal. The first exchange finds the classes of equal
sample strings; a suffix without a sample of a repeated class in its first v bytes is in no repeat. What remains, the
suffixes in or near repeats, is dealt to buckets by a fingerprint of its first span bytes. A task sorts one bucket; suffixes that
are equal there are repeats. Memory is bounded by the bucket and the chunk.

Equal means equal in two hashes: 64 bits, and 31 bits modulo a prime to a base that is drawn anew for each run. Texts can't be
made to collide in the second one, whose bound is 400 / 2^31 for any two different strings; two strings of usual text agree in
both with a probability of 2^-95. The sample's classes use 40 bits, where a false match only adds suffixes to the second exchange.

The classical construction breaks ties inside a bucket by the ranks of sample suffixes at an offset that depends on both
suffixes, so each suffix would carry the ranks of all |D| samples behind it, 17 numbers instead of one; here ties are
decided by the hashes of the whole string. That is the deviation from the named method.

Copies of a whole document are found first by a BLAKE2b digest of 128 bits; one of them stands for all in both exchanges.
A chunk names each of its texts once, with all documents that have it, so a text is in the exchange of digests at most once
for each chunk, however many copies of it there are.

Null texts count as empty; texts shorter than span lose nothing. Repeated rows are documents of their own, and copies of
each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.chunks import ask, dealt, make_chunks, squeeze, unsqueeze
from acutance.llm.common import PrimeHash, RollingHash, tidy
from acutance.session import materialise, shuffles_dropped

SPAN = 400
CHUNK_BYTES = 2 << 20
#: Keys of a shard or bucket, about.
SHARD_KEYS = 1_000_000
PRIME = 16


def singer_cover(q: int) -> tuple[int, np.ndarray]:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1, for q a power of two: the points of a line of the plane over GF(q).

    With g a primitive element of GF(q^3), the residues are the i for which the trace of g^i down to GF(q) is zero.
    """
    bits = 3 * (q.bit_length() - 1)
    v, order = q * q + q + 1, (1 << bits) - 1

    def times(a: int, b: int, poly: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a <<= 1
            if a >> bits:
                a ^= poly
            b >>= 1
        return out

    def powers(poly: int) -> list[int] | None:
        seen, x = [], 1
        for i in range(order):
            if i and x == 1:
                return None
            seen.append(x)
            x = times(x, 2, poly)
        return seen if x == 1 else None

    poly = next(p for p in range((1 << bits) + 1, 1 << (bits + 1), 2) if powers(p))
    elements = powers(poly)

    def to_q(x: int) -> int:  # trace down to GF(q): x + x^q + x^(q^2)
        total = 0
        for _ in range(3):
            total ^= x
            for _ in range(q.bit_length() - 1):
                x = times(x, x, poly)
        return total

    return v, np.array([i for i in range(v) if to_q(elements[i]) == 0], np.int64)


V, COVER = singer_cover(PRIME)


def _live(offsets: np.ndarray, skip: np.ndarray, span: int) -> np.ndarray:
    """Documents of a chunk that take part: long enough, and no copies of another."""
    return np.flatnonzero((np.diff(offsets) >= span) & ~skip)


def sample_positions(offsets: np.ndarray, docs: np.ndarray, span: int, v: int, cover: np.ndarray) -> np.ndarray:
    """Byte positions in the chunk of the sample of these documents, as far as a sample string fits."""
    length = span - v + 1
    out = []
    for d in docs:
        n = int(offsets[d + 1] - offsets[d]) - length + 1
        at = (np.arange(0, n, v)[:, None] + cover[None, :]).ravel()
        out.append(at[at < n] + offsets[d])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _flags(answers, sizes: list[int]) -> list[np.ndarray]:
    found = {a["shard"]: a["answer"] for a in answers or []}
    return [np.unpackbits(np.frombuffer(found[s], np.uint8), count=n).astype(bool) if s in found else np.zeros(n, bool) for s, n in enumerate(sizes)]


def _repeated(payloads: list[bytes]) -> list[bytes]:
    """For each payload of keys, or of keys and second keys: bits of those that occur more than once in the whole bucket."""
    parts = [unsqueeze(p) for p in payloads]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")  # one bucket at a time
    equal = keys[order][1:] == keys[order][:-1]
    if len(parts[0]) > 1:
        second = np.concatenate([p[1] for p in parts])
        if (equal & (second[order][1:] != second[order][:-1])).any():  # a tie of the first keys alone
            order = np.lexsort((second, keys))
            equal = keys[order][1:] == keys[order][:-1]
        equal &= second[order][1:] == second[order][:-1]
    same = np.zeros(len(keys), bool)
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(out, cuts)]


def _samples(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, span: int, shards: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    at = sample_positions(offsets, docs, span, V, COVER)
    keys = RollingHash(data).of(at, at + span - V + 1) if len(at) else np.zeros(0, np.uint64)
    return at, keys, dealt((keys % np.uint64(shards)).astype(np.int64), shards)


def _suffixes(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, at: np.ndarray, repeated: np.ndarray, span: int, shards: int):
    """Positions, fingerprints and buckets of the suffixes that have a repeated sample in their first V bytes."""
    n = len(data)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.maximum(at[repeated] - V + 1, 0), 1)
    np.add.at(marks, at[repeated] + 1, -1)
    near = np.cumsum(marks[:-1]) > 0
    ok = np.zeros(n, bool)
    for d in docs:
        ok[offsets[d] : offsets[d + 1] - span + 1] = True
    where = np.flatnonzero(near & ok)
    keys = RollingHash(data).of(where, where + span) if len(where) else np.zeros(0, np.uint64)
    return where, keys, dealt((keys % np.uint64(shards)).astype(np.int64), shards)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_bytes, spans, kept): spans of bytes (start, end) that are removed, in order, and the bytes that stay."""
    if span <= V:
        raise ValueError(f"span must be above {V}")
    base = secrets.randbelow(int(PrimeHash.P) - 1_000_000) + 500_000
    chunks = make_chunks(docs, key, text, chunk_bytes, "suffix-chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, int(total * len(COVER) / V) // SHARD_KEYS)

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, offsets = unsqueeze(batch.column("body")[row].as_py())
                raw, own = data.tobytes(), {}
                for i in range(len(offsets) - 1):
                    own.setdefault(hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest(), []).append(i)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[row].as_py()] * len(own), pa.int64()), pa.array(own.values(), pa.list_(pa.int32())), pa.array(own.keys(), pa.binary())], ["chunk", "own", "digest"])

    rows = materialise(chunks.select("chunk", "body").mapInArrow(digests, "chunk long, own array<int>, digest binary"), "suffix-digests")
    groups = rows.groupBy("digest").agg(F.sum(F.size("own")).alias("n"), F.min("chunk").alias("first")).where("n > 1")
    copies = rows.join(groups, "digest").groupBy("chunk").agg(F.collect_list(F.struct("own", (F.col("chunk") == F.col("first")).alias("first"))).alias("copies"))  # at most a chunk's documents
    chunks = chunks.join(copies, "chunk", "left")

    def parts(row: dict):
        data, offsets = unsqueeze(row["body"])
        skip = np.zeros(len(offsets) - 1, bool)
        for c in row["copies"] or []:
            skip[c["own"][c["first"] :]] = True  # in the first chunk, all but the first
        return data, offsets, _live(offsets, skip, span)

    def ask_samples(row: dict):
        data, offsets, live = parts(row)
        _, keys, buckets = _samples(data, offsets, live, span, shards)
        for s, own in enumerate(buckets):
            if len(own):  # 5 bytes of the hash are enough here: a false class only adds suffixes to the second exchange
                yield s, squeeze(keys[own] >> np.uint64(24))

    def found_suffixes(row: dict):
        data, offsets, live = parts(row)
        at, _, buckets = _samples(data, offsets, live, span, shards)
        repeated = np.zeros(len(at), bool)
        for own, flags in zip(buckets, _flags(row["answers"], [len(b) for b in buckets])):
            repeated[own] = flags
        return (data, offsets, *_suffixes(data, offsets, live, at, repeated, span, shards))

    def ask_suffixes(row: dict):
        data, _, where, keys, buckets = found_suffixes(row)
        second = PrimeHash(data, base).of(where, where + span) if len(where) else np.zeros(0, np.uint32)
        for s, own in enumerate(buckets):
            if len(own):
                yield s, squeeze(keys[own], second[own])

    with shuffles_dropped(docs.sparkSession):
        sampled = ask(chunks, ask_samples, _repeated, "cover-classes", ["chunk", "body", "copies"])
        judged = ask(sampled, ask_suffixes, _repeated, "suffix-buckets", ["chunk", "body", "copies", "answers"], "hits")
    schema = T.StructType([docs.schema[key]]).add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].as_py() for f in ("body", "copies", "answers", "hits")}
                data, offsets, where, _, buckets = found_suffixes(row)
                hit = np.zeros(len(where), bool)
                for own, flags in zip(buckets, _flags(row["hits"], [len(b) for b in buckets])):
                    hit[own] = flags
                marks = np.zeros(len(data) + 1, np.int64)
                np.add.at(marks, where[hit], 1)
                np.add.at(marks, where[hit] + span, -1)
                gone = np.cumsum(marks[:-1]) > 0
                for c in row["copies"] or []:
                    for d in c["own"]:
                        lo, hi = offsets[d], offsets[d + 1]
                        if hi - lo >= span:
                            gone[lo:hi] = True
                spans, kept = [], []
                for lo, hi in zip(offsets[:-1], offsets[1:]):
                    g = gone[lo:hi]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                    kept.append(data[lo:hi][~g].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("keys")[i].as_py(), batch.schema.field("keys").type.value_type), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], schema.names)

    return judged.select("keys", "body", "copies", "answers", "hits").mapInArrow(cut, schema)


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
