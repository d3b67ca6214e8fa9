"""Ranked lexical search (operator 11): postings of each term in blocks of similar documents, skipped by their summaries.

A query set is answered in blocks of queries with a bounded number of terms, each of them against all documents. One pass
over the texts writes shards of SHARD_ROWS documents at most: their lengths and their counts of the block's terms, with the
shard's part of the corpus statistics; shards follow the input's own partitions, so nothing is shuffled. N, L and
document frequencies are sums over all shards. A task then takes a shard, turns counts into impacts and cuts the posting list
of each term into blocks: a document goes to the nearest of the list's centres (documents of the list) by the cosine
of random projections of their weighted impacts. A block's summary is the maximum of each term's impact over its documents,
computed when a query first enters the list and kept for all the other queries.

A query goes through its lists from the one that can add most. In a list, blocks are taken from the largest product of query
and summary down, and are skipped when that bound is below the k-th score so far; documents of the others are scored in
full, once. It ends when all lists left could not lift an unseen document to the k-th score. A sixteenth of the shards, chosen by
hash, is searched first; the others start from the k-th scores found there. Bounds are exact sums of integers, and only
what is strictly below the k-th score is skipped, so the result is exact, ties by key included.

Null texts have no terms; a query without terms, or whose terms no document holds, gives no rows. Repeated documents are
ranked each, repeated queries have a list each; a null key comes last among equal scores. Empty tables give no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from acutance.llm.chunks import squeeze, unsqueeze
from acutance.llm.common import RollingHash, lower_ascii, text_slices, tidy
from acutance.llm.terms import ALNUM, WORD, raw_values, runs_of, values_of
from acutance.session import materialise, ship_package

#: Documents of a shard, terms of a block of queries (a long term counts for more), postings of a block, projections.
SHARD_ROWS, BLOCK_TERMS, BLOCK_ROWS, PROJECTIONS = 4096, 8192, 128, 32
FIRST_WAVE = 16


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """For slices of the texts: first and end row, the terms in order, and the row of each within the slice."""
    for lo, hi, data, offsets in text_slices(texts):
        lower = lower_ascii(data)
        mask = ALNUM[lower] == WORD
        starts, ends, rows = runs_of(mask, offsets)
        yield lo, hi, values_of(lower, mask, starts, ends), rows


def query_blocks(items: DataFrame, key: str, text: str, block_terms: int) -> DataFrame:
    """(block, body): the written blocks of queries: keys, distinct terms, and the terms of each query as numbers."""
    weight = F.lit(1) + F.coalesce(F.length(text), F.lit(0)) / 6
    parts = max(1, math.ceil((items.agg(F.sum(weight)).first()[0] or 0) / block_terms))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        keys, queries, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal known, keys, queries, number, size
            body = pickle.dumps((keys, list(known), queries))
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary())], ["block", "body"])
            known, keys, queries, number, size = {}, [], [], number + 1, 0
            return out

        for batch in batches:
            names = batch.column("key").to_pylist()
            for lo, hi, terms, rows in _terms(batch.column("text")):
                for i in range(lo, hi):
                    own = terms.filter(pa.array(rows == i - lo)).unique().to_pylist()
                    if not own:
                        continue
                    cost = sum(1 + len(t) // 64 for t in own if t not in known)
                    if known and size + cost > block_terms:
                        yield flush()
                        cost = sum(1 + len(t) // 64 for t in own)
                    size += cost
                    keys.append(names[i])
                    queries.append([known.setdefault(t, len(known)) for t in own])
        if keys:
            yield flush()

    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spread = rows.repartition(parts, F.xxhash64("key", "text")) if parts > 1 else rows.coalesce(1)
    return materialise(spread.mapInArrow(run, "block long, body binary"), "query-blocks")


def count_terms(docs: DataFrame, key: str, text: str, terms: list[bytes], shard_rows: int) -> DataFrame:
    """(shard, keys, body, stats): the written shards. body: lengths and counts of the terms; stats: N, L and document frequencies."""
    schema = T.StructType().add("shard", "long").add("keys", T.ArrayType(docs.schema[key].dataType)).add("body", "binary").add("stats", "binary")
    wanted, width = pa.array(terms, pa.large_binary()), len(terms)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        keys, parts, rows_seen, stats = [], [], 0, np.zeros(2 + width, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, rows_seen, stats, number
            whole = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(4)]
            body = squeeze(*(x.astype(kind) for x, kind in zip(whole, (np.uint32, np.uint32, np.uint32, np.uint32), strict=True)))
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([keys], pa.list_(kind_of_key)), pa.array([body], pa.binary()), pa.array([squeeze(stats)], pa.binary())], schema.names)
            keys, parts, rows_seen, stats, number = [], [], 0, np.zeros(2 + width, np.int64), number + 1
            return out

        for batch in batches:
            kind_of_key = batch.schema.field("key").type
            names = batch.column("key").to_pylist()
            for lo, hi, values, rows in _terms(batch.column("text")):
                n = np.bincount(rows, minlength=hi - lo)
                code = pc.index_in(values, value_set=wanted).fill_null(-1).to_numpy().astype(np.int64)
                both, tf = np.unique((rows * width + code)[code >= 0], return_counts=True)
                row, code = both // width, both % width
                stats[0] += np.count_nonzero(n)
                stats[1] += n.sum()
                stats[2:] += np.bincount(code, minlength=width)
                held, count = np.unique(row, return_counts=True)
                keys += [names[lo + i] for i in held.tolist()]
                parts.append((n[held], count, code, tf))
                rows_seen += len(held)
                if rows_seen >= shard_rows:
                    yield flush()
        if stats[0]:
            yield flush()

    return materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "lexical-shards")


def statistics(shards: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term, summed over all shards. width is bounded by the block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + width, np.int64)
        for batch in batches:
            for x in batch.column("stats"):
                total += unsqueeze(x.as_py())[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 + width)), pa.array(total)], ["i", "n"])

    got = {r.i: r.n for r in shards.select("stats").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    sums = np.array([got.get(i, 0) for i in range(2 + width)], np.int64)
    return int(sums[0]), int(sums[1]), sums[2:]


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)


class Shard:
    """A shard's impacts, its posting lists in blocks, and their summaries."""

    def __init__(self, body: bytes, keys: list, n_docs: int, length: int, weight: np.ndarray, axes: np.ndarray, block_rows: int):
        sizes, counts, codes, tf = (x.astype(np.int64) for x in unsqueeze(body))
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0)), np.int64)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys, self.block_rows, self.n = [keys[i] for i in order], block_rows, len(keys)
        row = np.repeat(np.arange(len(keys)), counts)
        m = 50 + (50 * sizes * n_docs) // max(1, length)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
        self.terms, column = np.unique(codes, return_inverse=True)
        self.impacts = np.zeros((self.n, len(self.terms)), np.float32)  # whole numbers below 2^24
        self.impacts[place[row], column] = impact
        self.most = self.impacts.max(axis=0, initial=0).astype(np.float64)
        self.number = {int(t): i for i, t in enumerate(self.terms)}
        points = self.impacts @ (axes[self.terms] * weight[self.terms, None]).astype(np.float32)
        self.points = points / np.maximum(np.sqrt((points**2).sum(axis=1, keepdims=True)), 1e-9)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A term's documents in the order of their blocks, the bounds of the blocks, and their summaries."""
        if column not in self.lists:
            docs = np.flatnonzero(self.impacts[:, column])
            many = -(-len(docs) // self.block_rows)
            centres = self.points[docs[(np.arange(many) * len(docs)) // many]]
            own = (self.points[docs] @ centres.T).argmax(axis=1) if many > 1 else np.zeros(len(docs), np.int64)
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            self.lists[column] = docs[order], np.append(first, len(docs)), np.maximum.reduceat(self.impacts[docs[order]], first, axis=0)
        return self.lists[column]

    def search(self, query: list[int], weight: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores above 0 and their documents, as far as they reach floor."""
        columns = np.array([self.number[t] for t in query if t in self.number and weight[t] > 0], np.int64)
        score, found = np.zeros(0), np.zeros(0, np.int64)
        if not len(columns):
            return score, found
        w = weight[self.terms[columns]].astype(np.float64)  # sums of products stay below 2^53
        reach = w * self.most[columns]
        order = np.argsort(-reach, kind="stable")
        left = np.cumsum(reach[order][::-1])[::-1]
        seen, least = np.zeros(self.n, bool), max(1.0, floor)
        for j, i in enumerate(order):
            if left[j] < least:
                break
            docs, bounds, summary = self.blocks(int(columns[i]))
            bound = summary[:, columns].astype(np.float64) @ w
            by, at, step = np.argsort(-bound, kind="stable"), 0, 1
            while at < len(by):
                some = by[at : at + step]
                some = some[bound[some] >= least]
                if not len(some):
                    break
                at, step = at + step, step * 2
                new = np.concatenate([docs[bounds[b] : bounds[b + 1]] for b in some])
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                s = self.impacts[np.ix_(new, columns)].astype(np.float64) @ w
                score, found = np.concatenate((score, s)), np.concatenate((found, new))
                best = np.lexsort((found, -score))[:k]
                score, found = score[best], found[best]
                if len(score) == k:
                    least = max(least, score[-1])
        keep = score >= least
        return score[keep], found[keep]


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 50, shard_rows: int = SHARD_ROWS, block_terms: int = BLOCK_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item, rank, key, score): the k documents with the highest scores for each row of items; equal scores by ascending key."""
    spark = docs.sparkSession
    ship_package(spark)
    item_kind, key_kind = items.schema[item].dataType, docs.schema[key].dataType
    schema = T.StructType().add("q", "long").add("key", key_kind).add("score", "long")
    whole = None
    for block in query_blocks(items, item, item_text, block_terms).toLocalIterator():
        names, terms, queries = pickle.loads(block.body)
        shards = count_terms(docs, key, text, terms, shard_rows)
        n, length, df = statistics(shards, len(terms))
        weight = weights(n, df)
        at = np.array([0, *np.cumsum([len(t) for t in terms])])
        seeds = RollingHash(np.frombuffer(b"".join(terms), np.uint8)).of(at[:-1], at[1:])
        axes = np.array([np.random.default_rng(int(s)).choice([-1.0, 1.0], PROJECTIONS) for s in seeds])

        def find(floors: dict[int, int], rows: DataFrame) -> DataFrame:
            @tidy
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for keys, body in zip(batch.column("keys"), batch.column("body"), strict=True):
                        shard = Shard(body.as_py(), keys.as_py(), n, length, weight, axes, block_rows)
                        qs, found, scores = [], [], []
                        for q, query in enumerate(queries):
                            s, d = shard.search(query, weight, k, floors.get(q, 0))
                            qs.append(np.full(len(s), q))
                            found += [shard.keys[i] for i in d]
                            scores.append(s)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs).astype(np.int64)), pa.array(found, batch.schema.field("keys").type.value_type), pa.array(np.concatenate(scores).astype(np.int64))], schema.names)

            return materialise(rows.select("keys", "body").mapInArrow(run, schema), "lexical-hits")

        early = F.pmod(F.xxhash64("shard"), F.lit(FIRST_WAVE)) == 0
        first = find({}, shards.where(early))
        kth = ranked(first, k).where(F.col("rank") == k)
        hits = first.unionByName(find({r.q: r.score for r in kth.select("q", "score").collect()}, shards.where(~early)))  # at most a row for each query of the block
        own = spark.createDataFrame(list(enumerate(names)), T.StructType().add("q", "long").add("item", item_kind))
        best = ranked(hits, k).join(F.broadcast(own), "q").select(F.col("item").alias(item), F.col("rank"), F.col("key").alias(key), "score")
        best = materialise(best, "lexical-best")
        whole = best if whole is None else whole.unionByName(best)
    if whole is None:
        whole = spark.createDataFrame([], T.StructType().add(item, item_kind).add("rank", "integer").add(key, key_kind).add("score", "long"))
    return whole


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps k rows of each in every task before they are shuffled."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
