"""LM scoring (operator 7): an n-gram trie in Elias-Fano levels.

The model is a bigram model on top of unigrams: P(w | v) = (r(v, w) + MU * P1(w)) / (c(v) + MU), with P1(w) =
(c(w) + 0.1) / (N + 0.1 * (V + 1)). It is normalised but for the quantisation of r.

Documents are packed into chunks. Each chunk asks shards about its distinct words and its distinct pairs of a context and
its successor, with how often they occur in its training documents. A pair's shard follows from the pair and not from
the context alone, so a frequent context is spread over all shards. A shard builds its part of the trie and answers from it:
contexts in the first level, in the second the successors of each context, with a code for the quantised probability of
the pair among all pairs. Levels are monotone sequences in Elias-Fano form: contexts; pointers to each context's first
successor; successors, made monotone by adding the context's rank in front. They are written to a file that the task maps
into memory; the file's name is removed at once, so nothing stays behind. A pair is looked up by the search for its
successor inside its context's range. With the counts of its words and the codes of its pairs, a chunk sums up its
documents. Shards and chunks are bounded, and their number grows with the corpus.

A word is known by a 64-bit hash, in chunks and in shards; in a pair 32 bits each stand for context and successor.

Null and empty texts are one end token. Repeated rows count each time. A null key counts as an empty text in the
choice of training rows. Without training rows all counts are 0. Empty tables give empty results.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.chunks import ask_with_sums, dealt, make_chunks, squeeze, unsqueeze
from acutance.llm.common import RollingHash, lower_ascii, mix64, tidy, word_bounds

CHUNK_BYTES, SHARD_BYTES = 4 << 20, 12 << 20
MU, ADD = 300.0, 0.1
#: Hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0xE0D), np.uint64(0x57A27)
#: A count n > 0 has the code 1 + round(log(n) / STEP); counts up to 10^9 fit one byte.
STEP = np.log(1.085)


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary, with a count of ones before each word."""

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.zeros(n * low, np.uint8)
        for b in range(low):
            bits[b::low] = (values >> np.uint64(b)) & np.uint64(1)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1 if n else 0) * 64, np.uint8)
        high[ones] = 1
        words = np.packbits(high, bitorder="little").view(np.uint64)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        low_bytes = np.concatenate((np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)))  # so that 8 bytes can be read anywhere
        return {"low": low_bytes, "high": words, "before": before, "shape": np.array([n, low], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.before = parts["low"], parts["high"], parts["before"]
        self.n, self.bits = (int(x) for x in parts["shape"])
        # The low bytes as a 64-bit word at every byte; low values have 57 bits at most.
        self.low_words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))

    def __len__(self) -> int:
        return self.n

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.zeros(0, np.int64)
        word = np.searchsorted(self.before, i, "right") - 1
        left, rest, base = (i - self.before[word]).astype(np.int64), np.asarray(self.high[word]), np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the half of the word that holds the wanted one
            half = rest & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            up = left >= ones
            left, base = np.where(up, left - ones, left), base + up * width
            rest = np.where(up, rest >> np.uint64(width), half)
        out = (word * 64 + base - i) << self.bits
        place = i * self.bits
        low = self.low_words[place >> 3] >> (place & 7).astype(np.uint64)
        return out | (low & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def first_at_least(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each x, the first place in [lo, hi) whose value is x or more, hi if there is none.

        Values lie between least and most and are spread evenly, as hashes are: the place is guessed by interpolation, every
        third time by halving. Equal neighbours don't occur.
        """
        lo, hi, least, most = lo.copy(), hi.copy(), least.astype(float), most.astype(float)
        todo, turn = np.flatnonzero(lo < hi), 0
        while len(todo):
            a, b, want = lo[todo], hi[todo], x[todo]
            share = 0.5 if turn % 3 == 2 else np.clip((want - least[todo]) / np.maximum(most[todo] - least[todo], 1), 0, 1)
            mid = np.minimum(a + ((b - a) * share).astype(np.int64), b - 1)
            value = self.at(mid)
            less, same = value < want, value == want
            lo[todo] = np.where(less, mid + 1, np.where(same, mid, a))
            hi[todo] = np.where(less, b, mid)
            least[todo], most[todo] = np.where(less, value, least[todo]), np.where(less, most[todo], value)
            todo, turn = todo[lo[todo] < hi[todo]], turn + 1
        return lo


class Trie:
    """Contexts, pointers, successors and codes of one shard, mapped from a file."""

    LEVELS = ("contexts", "pointers", "successors")

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """keys: sorted distinct context << 32 | successor."""
        context = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        # Inside its context a successor has 32 bits; with the context's rank in front the level is monotone.
        relative = (rank.astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        out = {"codes": code_of(counts)}
        for name, values, universe in zip(Trie.LEVELS, (context[first], np.append(first, len(keys)), relative), (1 << 32, len(keys) + 1, max(1, len(first)) << 32)):
            out |= {f"{name}.{k}": v for k, v in EliasFano.build(values, universe).items()}
        return out

    def __init__(self, parts: dict[str, np.ndarray]):
        self.codes = parts["codes"]
        self.contexts, self.pointers, self.successors = (EliasFano({k: parts[f"{n}.{k}"] for k in ("low", "high", "before", "shape")}) for n in self.LEVELS)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The code of each context << 32 | successor, 0 if the trie hasn't got it."""
        out, n = np.zeros(len(keys), np.uint8), len(self.contexts)
        if not n or not len(keys):
            return out
        context, successor = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        distinct, back = np.unique(context, return_inverse=True)
        zero = np.zeros(len(distinct), np.int64)
        node = self.contexts.first_at_least(distinct, zero, zero + n, zero, zero + (1 << 32))
        there = node < n
        there[there] = self.contexts.at(node[there]) == distinct[there]
        node, ok = node[back], there[back]
        node, wanted = node[ok], (node[ok] << 32) | successor[ok]
        lo, hi = self.pointers.at(node), self.pointers.at(node + 1)
        place = self.successors.first_at_least(wanted, lo, hi, node << 32, (node + 1) << 32)
        hit = place < hi
        hit[hit] = self.successors.at(place[hit]) == wanted[hit]
        found = np.zeros(len(node), np.uint8)
        found[hit] = self.codes[place[hit]]
        out[ok] = found
        return out


def map_from_file(parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays, mapped from one file that has no name any more."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    try:
        at, where = 0, {}
        with os.fdopen(handle, "wb") as f:
            for k, a in parts.items():
                pad = -at % 8
                f.write(b"\0" * pad + a.tobytes())
                where[k] = (at + pad, a.dtype, len(a))
                at += pad + a.nbytes
        return {k: np.memmap(path, dtype, "r", start, (n,)) if n else np.zeros(0, dtype) for k, (start, dtype, n) in where.items()}
    finally:
        os.unlink(path)


def code_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + np.rint(np.log(np.maximum(counts, 1)) / STEP), 255), 0).astype(np.uint8)


def count_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp((codes.astype(float) - 1) * STEP), 0.0)


def in_training(key, folds: int = 10) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds != 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and its end, and their rows, in order."""
    n = len(offsets) - 1
    lower = lower_ascii(data)
    starts, ends, rows = word_bounds(lower, offsets)
    words = RollingHash(lower).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    at = np.arange(len(words)) + rows
    stops = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    out, own = np.empty(len(words) + n, np.uint64), np.empty(len(words) + n, np.int64)
    out[at], own[at] = words, rows
    out[stops], own[stops] = END, np.arange(n)
    return out, own


class ChunkView:
    """A chunk's tokens, distinct words and distinct pairs, in the order in which they are sent to the shards."""

    def __init__(self, row: dict, shards: int):
        data, offsets = unsqueeze(row["body"])
        self.n = len(offsets) - 1
        self.train = np.array([in_training(k) for k in row["keys"]], bool)
        self.words, self.rows = tokens(data, offsets)
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[np.flatnonzero(np.concatenate(([True], self.rows[1:] != self.rows[:-1])))] = START
        weight = self.train[self.rows].astype(np.int64)
        self.distinct, self.word_at = np.unique(np.append(self.words, START), return_inverse=True)
        self.start_at, self.word_at = self.word_at[-1], self.word_at[:-1]
        self.word_count = np.bincount(self.word_at, weights=weight, minlength=len(self.distinct)).astype(np.uint32)
        self.word_shards = dealt((self.distinct % np.uint64(shards)).astype(np.int64), shards)
        context, successor = mix64(before + np.uint64(1)), mix64(self.words + np.uint64(2))
        keys = (context & np.uint64(0xFFFFFFFF00000000)) | (successor >> np.uint64(32))
        self.pairs, self.pair_at = np.unique(keys, return_inverse=True)
        self.pair_count = np.bincount(self.pair_at, weights=weight, minlength=len(self.pairs)).astype(np.uint32)
        self.pair_shards = dealt((mix64(self.pairs) % np.uint64(shards)).astype(np.int64), shards)
        self.before_at = np.concatenate(([self.start_at], self.word_at[:-1])) if len(self.word_at) else self.word_at
        self.before_at = np.where(before == START, self.start_at, self.before_at)


def _steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as its differences, byte by byte: first all lowest bytes, at last all highest ones, which are nearly all 0."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).ravel()


def _from_steps(raw: np.ndarray, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)


def _pack_pairs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    context = (keys >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    return squeeze(np.array([2], np.uint8), _steps(context[first]), np.diff(np.append(first, len(keys))).astype(np.uint32), keys.astype(np.uint32), counts)


def _unpack_pairs(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    _, context, run, successor, counts = parts
    return (np.repeat(_from_steps(context, np.uint32), run).astype(np.uint64) << np.uint64(32)) | successor, counts


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their summed counts, and where the keys of each part are among them."""
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts).astype(float), minlength=len(every)).astype(np.int64)
    return every, total, np.split(back, np.cumsum([len(k) for k in keys])[:-1])


def answer(payloads: list[bytes]) -> list[bytes]:
    """Answers of one shard: of words, their counts, and the sums of distinct and of all words; of pairs, the codes in its trie."""
    parts = [unsqueeze(p) for p in payloads]
    if parts[0][0][0] == 1:
        _, total, places = _totals([_from_steps(p[1], np.uint64) for p in parts], [p[2] for p in parts])
        sums = np.array([np.count_nonzero(total), total.sum()], np.int64)
        return [*(squeeze(total[at]) for at in places), sums.tobytes()]
    blocks = [_unpack_pairs(p) for p in parts]
    every, total, places = _totals([b[0] for b in blocks], [b[1] for b in blocks])
    trie = Trie(map_from_file(Trie.build(every[total > 0], total[total > 0])))
    codes = trie.lookup(every)  # each distinct pair once, in order
    return [*(squeeze(codes[at]) for at in places), np.zeros(2, np.int64).tobytes()]


def _read_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([np.frombuffer(x.as_py(), np.int64) for x in batch.column("answer")], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["v", "n"])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", mu: float = MU, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    chunks = make_chunks(docs, key, text, chunk_bytes, "lm-chunks")
    shards = max(1, (chunks.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes)

    def questions(row: dict):
        view = ChunkView(row, shards)
        for s, own in enumerate(view.word_shards):
            if len(own):
                yield s, squeeze(np.array([1], np.uint8), _steps(view.distinct[own]), view.word_count[own])
        for s, own in enumerate(view.pair_shards):
            if len(own):
                yield shards + s, _pack_pairs(view.pairs[own], view.pair_count[own])

    asked, sums_of = ask_with_sums(chunks, questions, answer, "lm-answers", ["chunk", "keys", "body"])
    parts = sums_of.mapInArrow(_read_sums, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    v, n = parts[0] or 0, parts[1] or 0
    schema = T.StructType([docs.schema[key]]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].as_py() for f in ("keys", "body", "answers")}
                view = ChunkView(row, shards)
                got = {a["shard"]: unsqueeze(a["answer"]) for a in row["answers"] or []}
                count, code = np.zeros(len(view.distinct)), np.zeros(len(view.pairs), np.uint8)
                for s, own in enumerate(view.word_shards):
                    if len(own):
                        count[own] = got[s][0]
                for s, own in enumerate(view.pair_shards):
                    if len(own):
                        code[own] = got[shards + s][0]
                # A text's start precedes one word of each training text: as often as the end occurs.
                end = np.searchsorted(view.distinct, END)
                count[view.start_at] = count[end] if view.n else 0
                p1 = (count + ADD) / (n + ADD * (v + 1))
                word, before = view.word_at, view.before_at
                p = (np.minimum(count_of(code)[view.pair_at], count[before]) + mu * p1[word]) / (count[before] + mu)
                per = lambda x: np.bincount(view.rows, weights=x, minlength=view.n)
                known = per((count[word] > 0).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(~view.train), pa.array(per(np.ones(len(word))).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(view.n, n, np.int64)), pa.array(per(np.log10(p1[word]))), pa.array(per(np.log10(p)))], schema.names)

    return asked.select("keys", "body", "answers").mapInArrow(sums, schema)
