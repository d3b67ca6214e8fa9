"""Exact top-k search by inner product (operator 5): a ball tree in each shard, branch and bound.

Vectors become integers, floor(scale * x). Pivots (a bounded sample, at most PIVOTS vectors) part the space: a vector goes to its
nearest pivot, whose vectors are dealt by a hash of the row to shards of about shard_rows, so neither a hot id nor a vector
that repeats fills a shard. A shard's ball tree (centres, radii, leaves of leaf_rows vectors) is one row of a table in
the shared folder. Queries are dealt to blocks in the same way. A block has a ball, too, so each block's shards are ordered by an upper
bound of their inner products before any tree moves. They are searched in waves, the best shard first, each later wave
twice as many as all before it; shards whose bound is below all k-th scores of the block are left out before the join, and the
rest start from the k-th scores found so far. A task holds one tree and up to PART_BLOCKS blocks: nodes are visited in the order of the largest
upper bound q.centre + |q| * radius over the block's queries that the node can still improve, and a node is left out for the
queries whose k-th score exceeds its bound.

Equal scores go to the smaller id, so a node is only left out if its bound is below the k-th score. Null vectors and those
with null, NaN or infinite components take no part; a shorter vector counts as filled up with zeros. Rows that repeat an
id are candidates each, and none of them for a query of that id; each of them that is a query has a list of its own. Fewer
than k candidates give fewer rows; an empty table gives none. Sums are exact while products stay below 2^53, else 64-bit
integers are used.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acutance.llm.common import located, trim
from acutance.session import materialise, ship_package

EMPTY = np.iinfo(np.int64).min
PIVOTS, PART_BLOCKS = 256, 32


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int) -> dict:
    """Nodes of a ball tree over the rows of x: centre, radius, first and end row, left and right child (-1: a leaf)."""
    order, nodes, stack = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        rows = x[order[lo:hi]].astype(np.float64)
        centre = rows.mean(axis=0)
        away = ((rows - centre) ** 2).sum(axis=1)
        nodes.append([centre, float(np.sqrt(away.max(initial=0))), lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = len(nodes) - 1
        if hi - lo > leaf_rows:  # split along the line between two far points
            a = rows[away.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            by = np.argsort(rows @ (b - a), kind="stable")
            order[lo:hi] = order[lo:hi][by]
            mid, me = (lo + hi) // 2, len(nodes) - 1
            stack += [(mid, hi, me, 1), (lo, mid, me, 0)]
    return {"ids": ids[order], "x": x[order], "centre": np.array([n[0] for n in nodes]).reshape(len(nodes), -1), "radius": np.array([n[1] for n in nodes]), "span": np.array([n[2:] for n in nodes], np.int64).reshape(-1, 4)}


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids in the tree for each query, as far as they can reach its floor; EMPTY where there are fewer."""
    m = len(query_ids)
    score, found = np.full((m, k), EMPTY, np.int64), np.full((m, k), np.iinfo(np.int64).max, np.int64)
    if not len(tree["ids"]):
        return score, found
    width = max(queries.shape[1], tree["x"].shape[1])
    fill = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
    q, x, centre = fill(queries), fill(tree["x"]), fill(tree["centre"])
    qf = q.astype(np.float64)
    bound = qf @ centre.T + np.sqrt((qf**2).sum(axis=1))[:, None] * tree["radius"][None, :]
    bound += np.abs(bound) * 1e-9 + 1e-6  # for rounding
    agenda = [(-bound[:, 0].max(), 0)]
    while agenda:
        _, node = heapq.heappop(agenda)
        active = np.flatnonzero(bound[:, node] >= np.maximum(score[:, -1], floor))
        if not len(active):
            continue
        lo, hi, left, right = tree["span"][node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(agenda, (-bound[active, child].max(), child))
            continue
        s, ids = _products(q[active], x[lo:hi]), np.broadcast_to(tree["ids"][lo:hi], (len(active), hi - lo))
        s = np.where(ids == query_ids[active][:, None], EMPTY, s)
        s, ids = np.hstack([score[active], s]), np.hstack([found[active], ids])
        ids = np.where(s == EMPTY, np.iinfo(np.int64).max, ids)
        best = np.lexsort((ids, -s.astype(np.float64) if np.abs(s[s != EMPTY]).max(initial=0) < 2**53 else ~s), axis=1)[:, :k]
        score[active], found[active] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
    return score, found


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [np.asarray(v, np.int64) for v in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest type that holds its values."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(np.float64) for m in (x, pivots))
    return ((b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)).argmin(axis=1)


def bound_of(block: str = "b", shard: str = "s") -> Column:
    """No q.x of a query in the block's ball and a vector in the shard's ball is larger."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x))
    q, c, rq, rc = F.col(f"{block}.centre"), F.col(f"{shard}.centre"), F.col(f"{block}.radius"), F.col(f"{shard}.radius")
    dot = F.aggregate(F.zip_with(q, c, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda n, x: n + x)
    bound = dot + rq * size(c) + (size(q) + rq) * rc
    return bound + (rq * size(c) + size(q) * size(c) + (size(q) + rq) * rc) * 1e-9 + 1e-6  # for rounding


def shard_order(queries: DataFrame, trees: DataFrame) -> DataFrame:
    """(block, shard, bound, i): the shards of each block from the largest bound down. A block is a bounded set of queries."""
    balls = queries.select("block", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(PIVOTS - 1))).alias("pivot"))
    pairs = balls.alias("b").join(trees.select("shard", "pivot", "centre", "radius").alias("s"), "pivot").select("block", "shard", bound_of().alias("bound"))
    return pairs.withColumn("i", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("bound"), "shard")) - 1)


def still_wanted(order: DataFrame, best: DataFrame | None, queries: DataFrame, done: int, width: int, k: int) -> DataFrame:
    """The pairs of a wave that can still improve a query, with the k-th scores known (as many as a block has queries)."""
    wave = order.where(F.col("i").between(done, done + width - 1))
    if best is None:
        return wave.withColumn("known", F.lit(None).cast("array<struct<q:bigint,s:bigint>>"))
    kth = best.groupBy("block", "q").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    kth = kth.groupBy("block").agg(F.collect_list(F.struct("q", "s")).alias("known"), F.min("s").alias("least"))
    wave = wave.join(queries.select("block", "size"), "block").join(kth, "block", "left")
    out = (F.size("known") == F.col("size")) & (F.col("bound") < F.col("least"))
    return wave.where(~F.coalesce(out, F.lit(False))).select("block", "shard", "bound", "i", "known")


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 16_384, leaf_rows: int = 128, block_rows: int = 1_024) -> DataFrame:
    """(query_id, rank, key, score): the k best other rows of every row whose key is divisible by every."""
    spark = vectors.sparkSession
    ship_package(spark)
    whole = F.transform(F.col(vector), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    found, at = located(vectors.select(key, vector))
    rows = found.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.xxhash64(at).alias("deal"))
    sample = rows.orderBy("deal").limit(max(1, min(PIVOTS, -(-rows.count() // shard_rows)))).toArrow()  # at most PIVOTS rows
    pivots = np.unique(_matrix(sample["v"]), axis=0) if sample.num_rows else np.zeros((1, 0), np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(_matrix(b.column("v")), pivots).astype(np.int32))], [*b.schema.names, "pivot"])

    rows = materialise(rows.mapInArrow(assign, "id long, v array<long>, deal long, pivot int"), "top-k-rows")
    is_query = F.col("id") % every == 0
    sizes = {r.pivot: (r.n, r.q) for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}  # at most PIVOTS rows

    def parts(which: int, target: int, salt: int) -> tuple[Column, int]:
        """The number of a row's part, and of all parts: each pivot has as many as its rows need."""
        many = [max(1, -(-sizes.get(p, (0, 0))[which] // target)) for p in range(len(pivots))]
        first = [0, *accumulate(many)]
        pick = lambda a: F.element_at(F.array(*map(F.lit, a)), F.col("pivot") + 1)
        return (pick(first[:-1]) + F.pmod(F.xxhash64("deal", F.lit(salt)), pick(many))).cast("long"), first[-1]

    shard, shards = parts(0, shard_rows, 0)
    block, blocks = parts(1, block_rows, 1)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id").combine_chunks()
        tree = build_tree(group["id"].to_numpy(), narrow(_matrix(group["v"])), leaf_rows)
        return pa.table({"shard": group["shard"][:1], "pivot": group["pivot"][:1], "centre": pa.array([tree["centre"][0].tolist()], pa.list_(pa.float64())), "radius": tree["radius"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("deal", "ascending")]).combine_chunks()
        x = _matrix(group["v"])
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        return pa.table({"block": group["block"][:1], "size": pa.array([len(x)], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "ids": pa.array([group["id"].to_numpy().tobytes()], pa.binary()), "v": pa.array([pickle.dumps(narrow(x))], pa.binary())})

    trees = materialise(rows.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, pivot int, centre array<double>, radius double, tree binary"), "ball-trees")
    queries = materialise(rows.where(is_query).withColumn("block", block).groupBy("block").applyInArrow(pack, "block long, size int, centre array<double>, radius double, ids binary, v binary"), "query-blocks")
    order = materialise(shard_order(queries, trees), "shard-order")

    def run(work: pa.Table, forest: pa.Table) -> pa.Table:
        out = []
        try:
            tree = pickle.loads(forest["tree"][0].as_py()) if work.num_rows else None
            for row in range(work.num_rows):
                ids = np.frombuffer(work["ids"][row].as_py(), np.int64)
                known = {x["q"]: x["s"] for x in work["known"][row].as_py() or []}
                floor = np.array([known.get(q, EMPTY) for q in range(len(ids))], np.int64)
                score, best = search(tree, ids, pickle.loads(work["v"][row].as_py()), k, floor)
                ok = score != EMPTY
                q = np.nonzero(ok)[0]
                out.append(pa.table({"block": np.full(len(q), work["block"][row].as_py(), np.int64), "q": q, "query_id": ids[q], "id": best[ok], "score": score[ok]}))
            return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("block", "q", "query_id", "id", "score")})
        finally:
            trim()

    best, done = None, 0
    while done < shards:
        width = min(shards - done, max(1, done * 2))
        wanted = still_wanted(order, best, queries, done, width, k)
        wanted = materialise(wanted.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, blocks // PART_BLOCKS)))), "top-k-wave")
        work = wanted.join(queries.select("block", "ids", "v"), "block").select("shard", "part", "block", "ids", "v", "known")
        forest = wanted.select("shard", "part").distinct().join(trees.select("shard", "tree"), "shard").select(F.col("shard").alias("s"), F.col("part").alias("p"), "tree")
        hits = work.groupBy("shard", "part").cogroup(forest.groupBy("s", "p")).applyInArrow(run, "block long, q long, query_id long, id long, score long")
        hits = hits if best is None else hits.unionByName(best)
        top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
        best = hits.groupBy("block", "q", "query_id").agg(top.alias("t")).select("block", "q", "query_id", F.explode("t").alias("t")).select("block", "q", "query_id", F.col("t.id").alias("id"), (-F.col("t.s")).alias("score"))
        best = materialise(best, "top-k")
        done += width
    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.desc("score"), "id"))
    return best.select("query_id", rank.alias("rank"), F.col("id").alias(key), "score")
