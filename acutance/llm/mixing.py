"""Mixing sources to target weights (operator 1) by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in the order of a hash of key and text, are one long sequence, cut into blocks of at most block_words
words (small sources into shorter ones). A source's target is its share of all words by weight, at most max_repeat times its
own size; what is cut off is reshared. The mix draws a source's blocks in passes: each full pass takes all of them, the last
pass as many as the target still needs. In each pass the blocks are placed by a keyed permutation (a Feistel network that
walks its cycles until inside the range), so no list of them is ever sorted or stored.

The tree deals blocks to output shards. A node holds, of each pass over a source, how many blocks are to be drawn below it
and how many are spare; both are split in two by multivariate hypergeometric samples without replacement, so that shards get
equal numbers of draws, down to the shards. What a shard gets of a pass is a run of places, drawn and spare ones together,
so shards are disjoint; which blocks of its run it draws follows from a permutation of its own. One shard's last
draws are cut so that the words taken are the target, rounded. A shard is shuffled within itself by a hash. There are as many
shards as the words to write need; the tree has as many numbers as shards times passes, documents and blocks never pass through it.

Positions in the sequence come from sums in three levels (document in bin, bin in group, group in source), so that no
window is larger than a bin or a group, however large a source is.

A null source is a source, ordered last. Null or empty texts have size 0 and are never drawn. Repeated rows are
documents of their own. Empty tables give empty results. Other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from acutance.llm.common import fresh, located, mix64, tidy
from acutance.session import materialise, ship_package

BIN_ROWS, GROUP_BINS = 64, 256
#: Words of an output shard, about; the tree's numbers and the sources are at most so many. More sources are an error, not dropped.
SHARD_WORDS, MOST_NUMBERS, MOST_SOURCES = 500_000, 2_000_000, 50_000
#: Above this many blocks the blocks are made longer: numpy's hypergeometric draw takes populations below 10^9.
MOST_BLOCKS = 400_000_000


def word_count(text: str = "text") -> Column:
    """Words are the runs of other characters between separators."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, max_repeat: float = 3.0) -> np.ndarray:
    """Words wanted of each source: shares of the total by weight, none above max_repeat times its size, the excess reshared."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    total, out, free = sizes.sum(), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        rest = total - out[~free].sum()
        share = rest * weights / weights[free].sum()
        over = free & (share > max_repeat * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = max_repeat * sizes[over]
        free &= ~over
    return out


def split_tree(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """draws (one number for each source) dealt to shards: an array of shards x sources whose columns sum to draws."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(draws)), np.int64)

    def hypergeometric(have: np.ndarray, want: int) -> np.ndarray:
        got, rest = np.zeros(len(have), np.int64), int(have.sum())
        for i, n in enumerate(have.tolist()):
            rest -= n
            got[i] = rng.hypergeometric(n, rest, want) if want and n + rest else 0
            want -= got[i]
        return got

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo))
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(draws.astype(np.int64), 0, shards)
    return out


def permuted(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """The place of each x in a keyed permutation of 0 .. n - 1; n and key may differ from one x to the next."""
    x = np.asarray(x, np.int64)
    n, key = np.broadcast_to(np.asarray(n, np.int64), x.shape), np.broadcast_to(np.asarray(key, np.int64), x.shape)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 2) // 2).astype(np.uint64)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        shift, keys = half[todo], key[todo].astype(np.uint64) * np.uint64(4)
        mask = (np.uint64(1) << shift) - np.uint64(1)
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(keys + np.uint64(r))) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class SourcePlan:
    """What the mix does with one source. Of each pass, for each shard: first place, places, draws; and the words cut off, and where."""

    size: int
    target: float
    block: int
    seed: int
    first: np.ndarray  # passes x shards
    pool: np.ndarray
    need: np.ndarray
    cut: int = 0
    cut_shard: int = 0

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def passes(self) -> int:
        return len(self.need)

    def draws(self, block: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block in a pass: its shard, its turn there, and whether it is drawn."""
        place = permuted(block, self.blocks, self.seed + 2 * p)
        shard = np.searchsorted(self.first[p], place, "right") - 1
        turn = permuted(place - self.first[p][shard], self.pool[p][shard], self.seed + 2 * p + 1 + 64 * shard)
        return shard, turn, turn < self.need[p][shard]

    def words(self, block: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each block in a pass: its shard, its turn, and from where to where in the block words are taken."""
        shard, turn, drawn = self.draws(block, p)
        take = np.where(drawn, np.minimum(self.block, self.size - block * self.block), 0)
        if self.cut and p == self.passes - 1:
            # The last draws of one shard are cut; all are block words long but the source's last block, if it is among them.
            own = drawn & (shard == self.cut_shard)
            at, last, there = self.draws(np.array([self.blocks - 1]), p)
            short = self.blocks * self.block - self.size if there[0] and at[0] == self.cut_shard else 0
            n = int(self.need[p][self.cut_shard])
            after = (n - 1 - turn) * self.block - np.where(turn < last[0], short, 0)
            take[own] -= np.clip(self.cut - after, 0, take)[own]
        return shard, turn, take


def plan_sources(rows: list[tuple], weigh, shards: int | None, seed: int, block_words: int, max_repeat: float) -> list[SourcePlan]:
    """rows: (source, size) in order; weigh(i): the weight of the i-th."""
    sizes = np.array([r[1] for r in rows], np.int64)
    goal = targets(sizes, np.array([weigh(i) for i in range(len(rows))]), max_repeat) if len(rows) else sizes
    least = -(-int(max_repeat * sizes.sum()) // MOST_BLOCKS) if len(rows) else 1
    block = [max(1, least, min(block_words, int(n) // 1024)) for n in sizes]
    blocks = [-(-int(n) // b) for n, b in zip(sizes, block)]
    parts = [divmod(round(float(t)), int(n)) if n else (0, 0) for n, t in zip(sizes, goal)]
    need = [[n] * full + ([-(-rest // b)] if rest else []) for n, b, (full, rest) in zip(blocks, block, parts)]
    columns = sum(map(len, need))
    shards = max(1, min(shards or -(-int(goal.sum()) // SHARD_WORDS), MOST_NUMBERS // max(columns, 1)))
    while True:
        wanted = np.array([x for source in need for x in source], np.int64)
        spare = np.array([n - x for n, source in zip(blocks, need) for x in source], np.int64)
        draws, extra = split_tree(wanted, shards, seed), split_tree(spare, shards, seed + 1)
        plans, at, again = [], 0, False
        for i, source in enumerate(need):
            own, pool = draws[:, at : at + len(source)].T, (draws + extra)[:, at : at + len(source)].T
            at += len(source)
            plan = SourcePlan(int(sizes[i]), float(goal[i]), block[i], (seed + i) * 1_000_003, np.cumsum(pool, axis=1) - pool, pool, own)
            if parts[i][1]:
                p = plan.passes - 1
                plan.cut_shard = int(own[p].argmax())
                short = plan.blocks * plan.block - plan.size if plan.draws(np.array([plan.blocks - 1]), p)[2][0] else 0
                plan.cut = source[p] * plan.block - short - parts[i][1]
                if plan.cut < 0:  # the short block is among the draws: one more is needed
                    source[p] += 1
                    again = True
            plans.append(plan)
        if not again:
            return plans


def spans_of(plan: SourcePlan, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The drawn spans of documents that lie at start in the sequence: document, pass, first word, words, shard, order."""
    n = np.where(size > 0, (start + size - 1) // plan.block - start // plan.block + 1, 0)
    doc = np.repeat(np.arange(len(start)), n)
    block = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start // plan.block, n)
    distinct, back = np.unique(block, return_inverse=True)
    found = []
    for p in range(plan.passes):
        shard, turn, take = (x[back] for x in plan.words(distinct, p))
        lo = np.maximum(start[doc], block * plan.block)
        hi = np.minimum(start[doc] + size[doc], block * plan.block + take)
        ok = hi > lo
        order = mix64((turn[ok].astype(np.uint64) << np.uint64(16)) ^ mix64(shard[ok].astype(np.uint64) ^ np.uint64(plan.seed + p)))
        found.append((doc[ok], np.full(ok.sum(), p), lo[ok] - start[doc[ok]], hi[ok] - lo[ok], shard[ok], order.astype(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found))


def positions(docs: DataFrame, key: str) -> DataFrame:
    """docs(source, size, ...) with start: the words of the same source that come before, in the order of their hashes h."""
    rows = docs.groupBy("source").agg(F.count("*").alias("rows"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BIN_ROWS))).cast("int")
    rows = rows.select(F.col("source").alias("s"), F.expr("1L").alias("one"), bits.alias("bits"))
    binned = docs.join(F.broadcast(rows), F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", F.expr("shiftrightunsigned(h, 64 - bits) * cast(bits > 0 as long)")).drop("s", "one", "bits")
    binned = materialise(binned, "mix-bins")
    group = F.floor(F.col("bin") / GROUP_BINS)
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("group", group)
    groups = bins.groupBy("source", "group").agg(F.sum("words").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("source", "group", before.alias("g0"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source", "group").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("source", "bin", "group", before.alias("b0"))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    bins = bins.alias("b").join(groups.alias("g"), F.expr("b.source <=> g.source and b.group = g.group")).select("b.source", "b.bin", (F.col("b0") + F.col("g0")).alias("b0"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("source", "bin").orderBy("h", key, "size", *[c for c in ("_keep",) if c in docs.columns]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = binned.withColumn("inner", inner)
    placed = placed.alias("d").join(bins.alias("b"), F.expr("d.source <=> b.source and d.bin = b.bin"))
    return placed.select("d.*", (F.col("inner") + F.col("b0")).alias("start")).drop("inner", "bin", "h")


SPAN = T.StructType().add("pass", "integer").add("first_word", "long").add("words", "long").add("shard", "integer").add("position", "long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weigh=lambda i: (5, 2, 1)[i % 3], shards: int | None = None, seed: int = 7, block_words: int = 256, max_repeat: float = 3.0, keep: str | None = None) -> DataFrame:
    """A row for each document: key, source, size, source_size, target, taken and spans, an array of what the mix draws.

    A span is (pass, first_word, words, shard, position): in that output shard, in the order of position, stand these
    words of the document. weigh gives the weight of the i-th source in code point order. keep: one more column to keep.
    """
    spark = docs.sparkSession
    ship_package(spark)
    narrow = docs.select(F.col(key).alias(key), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("h"), *([F.col(keep).alias("_keep")] if keep else []))
    narrow = materialise(narrow, "mix-sizes")
    # A source is an entry of the mixture's configuration: its few sums make the plan.
    sums = narrow.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them before they are mixed")
    rows = sorted(((r["source"], r["size"] or 0) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    plans = plan_sources(rows, weigh, shards, seed, block_words, max_repeat)
    by_source = {r[0]: p for r, p in zip(rows, plans)}
    sent = spark.sparkContext.broadcast(by_source)
    schema = T.StructType([narrow.schema[key]]).add("source", "string").add("size", "long").add("source_size", "long").add("target", "double").add("taken", "long").add("spans", T.ArrayType(SPAN))
    schema = schema.add("_keep", narrow.schema["_keep"].dataType) if keep else schema
    arrow_span = pa.struct([("pass", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64()), ("shard", pa.int32()), ("position", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = sent.value
        for batch in batches:
            names, start, size = batch.column("source").to_pylist(), batch.column("start").to_numpy(), batch.column("size").to_numpy()
            parts = []
            for name in set(names):
                at = np.array([i for i, x in enumerate(names) if x == name], np.int64)
                doc, *rest = spans_of(plan_of[name], start[at], size[at])
                parts.append((at[doc] if len(doc) else doc, *rest))
            doc, p, first, words, shard, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
            order = np.lexsort((first, p, doc))
            ends = np.searchsorted(doc[order], np.arange(len(names) + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(p[order].astype(np.int32)), pa.array(first[order]), pa.array(words[order]), pa.array(shard[order].astype(np.int32)), pa.array(place[order])], fields=list(arrow_span))
            taken = np.bincount(doc, weights=words, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("source"), batch.column("size"), pa.array([plan_of[x].size for x in names], pa.int64()), pa.array([plan_of[x].target for x in names], pa.float64()), pa.array(taken), pa.ListArray.from_arrays(ends, values), *([batch.column("_keep")] if keep else [])], schema.names)

    return positions(narrow, key).mapInArrow(run, schema)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of docs, a row for each pass over a document: all of its text, or the drawn part of it, whole words with
    the separators that follow them. Documents of which nothing is drawn are left out.

    A row is written to the shard of its first span, in a partition with all of that shard, in the order of the shard's shuffle.
    Draws go to the row they were made for, so repeated or null keys neither add nor lose words.
    """
    rows, at = located(docs)
    found = mix(rows, key, text, keep=at, **options)
    spans, size = fresh(rows, "_spans"), fresh(rows, "_size")
    drawn = F.expr("transform(array_distinct(spans.pass), p -> filter(spans, s -> s.pass = p))")
    drawn = found.where("taken > 0").select(F.col("_keep").alias(at), F.col("size").alias(size), F.explode(drawn).alias(spans))
    word_at = F.expr(f"regexp_extract_all(coalesce(`{text}`, ''), '^[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*|[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    part = F.when(F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.words) = {size}"), F.col(text)).otherwise(F.concat_ws("", F.flatten(F.transform(spans, lambda s: F.slice(word_at, s["first_word"] + 1, s["words"].cast("int"))))))
    joined = rows.join(drawn, at).withColumn(text, part)
    order = [F.expr(f"{spans}[0].position"), F.col(at), F.expr(f"{spans}[0].pass")]
    return joined.repartition(F.expr(f"{spans}[0].shard")).sortWithinPartitions(F.expr(f"{spans}[0].shard"), *order).select(*[F.col(f"`{c}`") for c in docs.columns])
