"""SimHash near-duplicates (operator 3): pigeonhole blocks, a join on blocks, then a check of the Hamming distance.

A fingerprint has a bit set if more than half of the text's shingle hashes have it. The 64 bits are cut into r + 2
blocks; two fingerprints at distance r or less agree on two of the blocks at least, so each fingerprint is filed under
every pair of blocks, and only fingerprints in one file are compared. Equal fingerprints are one node from the start.

A file with more than file_rows fingerprints is not compared pair by pair. There, each fingerprint is sent to the
points one flip away (and to itself): two fingerprints at distance 2 or less have such a point in common, and those of
a point are at distance 2 at most, so a star from the point's smallest fingerprint links them exactly, in linear
work. This exact way is for r = 2; with other r, large files are filed anew under more blocks.

Components come from the alternating large-star and small-star rounds of Kiveris et al. (2014), written to the shared
folder after each round. Nothing is collected.

similar_documents is for texts that are much less alike (five-word shingles, Jaccard similarity 0.8): longer fingerprints, many
blocks whose length grows with the corpus, a check of the Hamming distance and then of the exact similarity.

Null and empty texts have the fingerprint zero and link like others. Repeated rows and ids are one component and one
row each. A null id is never a component's smallest unless no other is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acutance.llm.common import BROADCAST_ROWS, keep_matching, located, lower_ascii, mix64, text_slices, tidy, word_bounds
from acutance.session import materialise, ship_package

RADIUS = 2
FILE_ROWS = 64
#: A file is dealt to parts if more than HOT_ROWS fingerprints are expected in it; a part has about PART_ROWS at most.
HOT_ROWS, SAMPLE, PART_ROWS = 4_096, 64, 20_000
#: Hubs that a fingerprint meets in a round, and pairs for each fingerprint that the last round may compare.
HUBS, LAST_PAIRS = 8, 64
#: Words of a fingerprint that are carried into the join of the last round; members of a part of a crowd.
HEAD_WORDS, CROWD_ROWS = 4, 256


def shingle_spans(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[int, bytes, list[int], list[int]]]:
    """For each row of a slice that has words: its number, the slice's words joined by single spaces, and where each shingle begins and ends there."""
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    where = np.repeat(at[:-1] - starts, lengths) + np.concatenate([np.zeros(0, np.int64), np.arange(lengths.sum())]) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    joined[where] = lower_ascii(data)[where - np.repeat(at[:-1] - starts, lengths)]
    text = joined.tobytes()
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(per_row)))
    for i in np.flatnonzero(per_row):
        lo, hi = first[i], first[i + 1]
        k = min(shingle, hi - lo)
        yield i, text, at[lo : hi - k + 1].tolist(), (at[lo + k : hi + 1] - 1).tolist()


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each row of a slice: every occurrence of a shingle votes."""
    out, digest = np.zeros(len(offsets) - 1, np.uint64), xxhash.xxh64_intdigest
    for i, text, begin, end in shingle_spans(data, offsets, shingle):
        count = len(begin)
        votes = np.zeros(64, np.int64)
        for a in range(0, count, 8192):
            hashes = np.fromiter((digest(text[s:e], 42) for s, e in zip(begin[a : a + 8192], end[a : a + 8192])), np.uint64, min(8192, count - a))
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > count, bitorder="little").view(np.uint64)[0]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row of a slice, sorted."""
    out, digest = [np.zeros(0, np.uint64)] * (len(offsets) - 1), xxhash.xxh64_intdigest
    for i, text, begin, end in shingle_spans(data, offsets, shingle):
        out[i] = np.unique(np.fromiter((digest(text[s:e], 42) for s, e in zip(begin, end)), np.uint64, len(begin)))
    return out


def wide_fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """width words of 64 bits: each distinct hash, scrambled once a word, votes once."""
    salts, votes = mix64(np.arange(width, dtype=np.uint64))[None, :], np.zeros(64 * width, np.int64)
    for a in range(0, len(hashes), 8192):
        votes += np.unpackbits(mix64(hashes[a : a + 8192, None] ^ salts).view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", to: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs and the fingerprint as a long."""
    ship_package(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != to]
    schema = T.StructType([docs.schema[c] for c in names]).add(to, "long")
    src = docs.select(*names, *([] if text in names else [text]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprints_of(data, offsets, shingle) for _, _, data, offsets in text_slices(batch.column(text))]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp.view(np.int64))], schema.names)

    return src.mapInArrow(run, schema)


def block_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of which two fingerprints within the radius agree on one at least: any agree of radius + agree blocks."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [sum(c) for c in combinations(blocks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = RADIUS, file_rows: int = FILE_ROWS, agree: int = 2) -> DataFrame:
    """Links (a, b), a < b, that join exactly the fingerprints (distinct values of fp) within the radius."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(radius, agree)])
    filed = fps.select("fp", F.posexplode(masks).alias("m", "mask")).select("fp", "m", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = filed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = materialise(filed.join(sizes, ["m", "key"]), "simhash-files")
    small, large = filed.where(F.col("n") <= file_rows), filed.where(F.col("n") > file_rows)
    other = small.select("m", "key", F.col("fp").alias("other"))
    near = small.join(other, ["m", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
    out = near.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    if large.isEmpty():
        return out
    crowd = large.select("fp").distinct()
    if radius == 2:
        flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
        points = crowd.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("point"))
        centre = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
        stars = points.join(centre, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        return out.unionByName(stars).distinct()
    if agree > 6:
        raise ValueError("fingerprints too dense for this radius")
    return out.unionByName(links(crowd, radius, file_rows, agree + 1)).distinct()


def _state(pairs: DataFrame) -> tuple:
    """A digest of a set of links: it stays the same only when no round changes anything."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum("v" if dict(pairs.dtypes)["v"] == "int" else F.xxhash64("v") % (1 << 40))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that is reachable, for every node of the edges."""
    pairs = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = _state(pairs)
    for _ in range(max_rounds):
        # Large star: each node points its larger neighbours to the least of its neighbourhood.
        both = pairs.union(pairs.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        # Small star: each node points its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialise(small, "small-star")
        before, pairs = state, small
        state = _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("components have not settled")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) for every row of docs."""
    rows = materialise(with_fingerprint(docs, shingle, text, keep=[key]), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp"), radius))
    found = found.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = found.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = found.join(least, "label").select(F.col("node").alias("fp"), "component_id")
    ids = nodes.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(ids, "fp").select(key, "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _longs(rows: list[np.ndarray]) -> pa.Array:
    """A list array of longs, one list for each array of words."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))).cast(pa.list_(pa.field("element", pa.int64(), False)))


def wide_fingerprints(docs: DataFrame, kept: list[str], text: str, shingle: int, width: int) -> DataFrame:
    """The kept columns, node and fp: node is a hash of the text's set of shingles, fp its fingerprint as width longs, or the set itself with width 0."""
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in kept]).add("node", "long").add("fp", T.ArrayType(T.LongType(), False))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                own = shingle_sets(data, offsets, shingle)
                node = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in own], np.uint64).view(np.int64))
                fps = [wide_fingerprint(x, width) for x in own] if width else own
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), node, _longs(fps)], schema.names)

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def block_bits(bits: int, key_bits: int, blocks: int) -> np.ndarray:
    """The bits of each block: all bits are dealt to blocks of key_bits, and dealt anew until there are enough blocks."""
    per, rng = bits // key_bits, np.random.default_rng(24)
    return np.concatenate([rng.permutation(bits)[: per * key_bits].reshape(per, key_bits) for _ in range(-(-blocks // per))])


def block_keys(nodes: DataFrame, width: int, key_bits: int, blocks: int) -> DataFrame:
    """(k, node): a row for each block of each fingerprint; k is the block's number and its bits."""
    places = block_bits(64 * width, key_bits, blocks)
    number = np.arange(len(places), dtype=np.int64) << key_bits

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").flatten().to_numpy().view(np.uint8).reshape(-1, 8 * width)
            bits = np.unpackbits(fp, axis=1, bitorder="little")
            node = batch.column("node").to_numpy()
            for lo in range(0, len(bits), 256):
                part = bits[lo : lo + 256]
                own = np.zeros((len(part), len(places), 64), np.uint8)
                own[:, :, :key_bits] = part[:, places]
                k = np.packbits(own, axis=2, bitorder="little").view(np.int64)[:, :, 0] + number
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(node[lo : lo + 256], len(places)))], ["k", "node"])

    return nodes.select("node", "fp").mapInArrow(run, "k long, node long")


def _order(node: str, turn: int) -> Column:
    """Who becomes hub in a round: the least of these. It is the same order in all files, so that few hubs serve a group of copies."""
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("order"), F.col(node).alias("node"))


def files_of(nodes: DataFrame, n: int, width: int, key_bits: int, blocks: int) -> DataFrame:
    """(node, files, hubs): of each fingerprint that shares a file with another, all such files, and hubs it meets there.

    A hash sample of the fingerprints tells which files are large. The members of these are dealt to parts by a hash; each
    part has a hub, and these meet the file's. So no window is larger than HOT_ROWS or a part, about; the sample decides how
    the work is dealt and nothing else.
    """
    keys = block_keys(nodes, width, key_bits, blocks)
    sample = block_keys(nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLE)) == 0), width, key_bits, blocks)
    hot = materialise(sample.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_ROWS // SAMPLE).select("k"), "wide-hot")
    known = hot.limit(BROADCAST_ROWS + 1).count()
    if known:
        marked = hot.withColumn("hot", F.lit(True))
        filed = keys.join(F.broadcast(marked) if known <= BROADCAST_ROWS else marked, "k", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("node", F.lit(5)), F.lit(-(-n // PART_ROWS)))).otherwise(0))
    else:
        filed = keys.withColumns({"hot": F.lit(None).cast("boolean"), "part": F.lit(0)})
    part = Window.partitionBy("k", "part")
    filed = filed.withColumns({"n": F.count("*").over(part), "hub": F.min(_order("node", 0)).over(part)}).where("n > 1 or hot").select("k", "node", "hot", "part", "hub")
    if known:
        filed = materialise(filed, "wide-files")
        tops = filed.where("hot").groupBy("k", "part").agg(F.min("hub").alias("hub"))
        tops = tops.withColumn("top", F.min("hub").over(Window.partitionBy("k"))).where("hub <> top").select("k", F.col("hub.node").alias("node"), F.col("top").alias("hub"))
        filed = filed.select("k", "node", "hub").unionByName(tops)
    own = filed.groupBy("node").agg(F.collect_set("k").alias("files"), F.collect_set(F.when(F.col("hub.node") != F.col("node"), F.col("hub"))).alias("hubs"))  # as many as blocks, at most
    return materialise(own, "wide-members")


def _first(hubs: str, node: str = "node") -> DataFrame:
    return F.explode(F.slice(F.sort_array(hubs), 1, HUBS))


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def verified(docs: DataFrame, at: str, pairs: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float, limit: int) -> DataFrame:
    """The pairs within the Hamming limit whose sets of shingles have at least that Jaccard similarity, exactly."""
    fps = nodes.select("node", "fp")
    pairs = pairs.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b")
    pairs = materialise(pairs.where(_distance("fa", "fb") <= limit).select("a", "b"), "wide-pairs")
    asked = materialise(pairs.select("a").union(pairs.select("b")).toDF("node").distinct().join(nodes.select("node", F.col("at").alias(at)), "node").select(at), "wide-asked")
    sets = materialise(wide_fingerprints(keep_matching(docs, asked, [at], "left_semi"), [], text, shingle, 0), "wide-sets")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialise(both.where(F.col("common") + 1e-9 >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"), "wide-links")


def _distance(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, d: s + d)


def unsettled(members: DataFrame, nodes: DataFrame, found: DataFrame, crowds: DataFrame | None, least: int, turn: int = 0) -> DataFrame:
    """(k, node, label, crowd, head, n, hub): the members of files of least members or more that hold several components.

    A file that lies in one crowd is settled. n: members of the file; hub: (order, node) and label of one of them.
    """
    own = members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = own.withColumn("crowd", F.lit(None).cast("long")) if crowds is None else own.join(crowds, "node", "left")
    own = own.join(nodes.select("node", F.slice("fp", 1, HEAD_WORDS).alias("head")), "node")
    rows = own.select("node", "label", "crowd", "head", F.explode("files").alias("k"))
    group = F.struct(F.col("crowd").isNull().alias("alone"), F.coalesce("crowd", "label").alias("id"))
    files = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(group).alias("first"), F.max(group).alias("last"),
        F.min(F.struct(_order("node", turn).alias("o"), "label")).alias("hub")).where((F.col("n") >= least) & (F.col("low") < F.col("high")) & (F.col("first") < F.col("last")))
    return materialise(rows.join(files.select("k", "n", "hub"), "k"), "wide-unsettled")


def across(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): the pairs of members of one small file, in different components and not of one crowd, whose first words are within the limit."""
    one = rows.select("k", "node", "label", "crowd", "head")
    other = one.toDF("k", *[f"{c}_b" for c in one.columns[1:]])
    apart = (F.col("label") < F.col("label_b")) & F.coalesce(F.col("crowd") != F.col("crowd_b"), F.lit(True))
    return _pairs(one.join(other, "k").where(apart & (_distance("head", "head_b") <= limit)), "node", "node_b")


def alike_in_parts(table: pa.Table, similarity: float, limit: int) -> pa.Table:
    """(a, b): the members of side 0 and of side 1 in different components, within the Hamming limit and alike enough by their sets."""
    table = table.combine_chunks()
    side, node, label = (table.column(c).to_numpy() for c in ("side", "node", "label"))
    fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
    sets = table.column("set").combine_chunks()
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
    left, right, found = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
    for i in left:
        near = right[(label[right] != label[i]) & (np.bitwise_count(fp[right] ^ fp[i]).sum(axis=1, dtype=np.int64) <= limit)]
        if not len(near):
            continue
        own = flat[ends[i] : ends[i + 1]]
        sizes = ends[near + 1] - ends[near]
        every = np.concatenate([flat[ends[j] : ends[j + 1]] for j in near]) if sizes.sum() else flat[:0]
        hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every if len(own) else np.zeros(len(every), bool)
        common = np.bincount(np.repeat(np.arange(len(near)), sizes), weights=hit, minlength=len(near))
        good = near[common + 1e-9 >= similarity * (len(own) + sizes - common)]
        found += [(node[i], node[j]) for j in good]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def in_crowds(docs: DataFrame, at: str, rows: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float, limit: int) -> DataFrame:
    """(a, b): the pairs of each crowd's members that are in different components and alike enough, exactly.

    A crowd is what files of more than FILE_ROWS members join. It is cut into parts of CROWD_ROWS by a hash; a task compares
    two parts, so none holds a crowd, and writes links only.
    """
    members = rows.select("node", "label", "crowd").distinct().join(nodes.select("node", "fp", "at"), "node")
    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / CROWD_ROWS).cast("int").alias("parts"))
    members = materialise(members.join(sizes, "crowd"), "wide-crowds")
    asked = members.select(F.col("at").alias(at))
    sets = wide_fingerprints(keep_matching(docs, asked, [at], "left_semi"), [], text, shingle, 0).toDF("node", "set")
    members = members.drop("at").join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    first = members.select("crowd", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "node", "label", "fp", "set")
    second = members.select("crowd", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "node", "label", "fp", "set")
    return first.union(second).groupBy("crowd", "i", "j").applyInArrow(lambda t: alike_in_parts(t, similarity, limit), "a long, b long").distinct()


def similar_rows(docs: DataFrame, key: str, text: str, shingle: int, similarity: float, width: int, miss: float, spare_bits: int, last_pairs: int) -> tuple[DataFrame, DataFrame, str]:
    """(key, row, label) for every row, the rows with their locators, and the locator's name. Rows of one label are linked."""
    docs, at = located(docs)
    rows = materialise(wide_fingerprints(docs.withColumn("_key", F.col(key)), ["_key", at], text, shingle, width), "wide")
    nodes = materialise(rows.groupBy("node").agg(F.min(at).alias("at"), F.first("fp").alias("fp")), "wide-nodes")
    n = max(2, nodes.count())
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bound = lambda bits: int(bits * differ + 5 * math.sqrt(bits * differ * (1 - differ)))
    key_bits = min(40, max(12, math.ceil(math.log2(n)) + spare_bits))
    blocks = math.ceil(math.log(miss) / math.log(1 - (1 - differ) ** key_bits))
    check = lambda pairs: verified(docs, at, pairs, nodes, text, shingle, similarity, bound(64 * width))
    members = files_of(nodes, n, width, key_bits, blocks)
    links = check(_pairs(members.select("node", _first("hubs").alias("hub")).select("node", F.col("hub.node").alias("hub")), "node", "hub"))
    before, crowds = math.inf, None
    for turn in range(1, 20):
        found = components(links)
        large = unsettled(members, nodes, found, None, FILE_ROWS + 1, turn)
        left = large.select("k", "n").distinct().agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        if left <= last_pairs * n or left > before * 0.7:
            break
        before = left
        hubs = large.where(F.col("label") != F.col("hub.label")).groupBy("node").agg(F.collect_set("hub").alias("hubs"))
        links = links.union(check(_pairs(hubs.select("node", _first("hubs").alias("hub")).select("node", F.col("hub.o.node").alias("hub")), "node", "hub")))
    if left:
        crowds = materialise(components(large.select("node", F.col("hub.o.node").alias("hub")), "node", "hub").toDF("node", "crowd"), "wide-crowd-ids")
        links = links.union(in_crowds(docs, at, large.drop("crowd").join(crowds, "node"), nodes, text, shingle, similarity, bound(64 * width)))
    found = components(links.union(check(across(unsettled(members, nodes, found, crowds, 2), bound(64 * HEAD_WORDS)))))
    labelled = rows.select("_key", at, "node").join(found, "node", "left").select("_key", at, F.coalesce("label", "node").alias("label"))
    return materialise(labelled, "wide-labels"), docs, at


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = 12, miss: float = 0.01, spare_bits: int = 7, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """(key, component_id) for every row: documents are linked if the Jaccard similarity of their sets of distinct shingles is at least that.

    A fingerprint of width words is dealt to blocks, again and again; fingerprints that agree on a block are in one file. A
    block has log2 of the number of fingerprints plus spare_bits bits, so that chance fills files at the same rate in a
    corpus of any size, and there are so many blocks that a pair at the limit shares one but for the share miss; more alike
    pairs miss less. Candidates within the Hamming distance of the limit plus five standard errors are linked if the exact
    Jaccard similarity of their sets is high enough. What can be missed is a pair that agrees on no block.

    Which pairs of a file are compared: in the first rounds its members meet a few hubs each, which is linear; rounds after the
    first are for files of more than FILE_ROWS members. Files whose members are then in one component are settled. When large files
    leave few pairs for each fingerprint, or these don't get less, all pairs of members in different components are compared:
    those of large files (what they join is a crowd) part by part, those of small ones in a join. So the result is that of all pairs of all files. Many texts that are nearly
    alike enough, and aren't linked, cost their number's square there, in tasks of a bounded size that write links only.

    A text of fewer words is one shingle; null, empty and blank texts are alike. component_id is the least key of the
    component, null only if all its keys are. Rows that repeat a key or a text are rows of their own.
    """
    found, _, _ = similar_rows(docs, key, text, shingle, similarity, width, miss, spare_bits, last_pairs)
    least = found.groupBy("label").agg(F.min("_key").alias("component_id"))
    return found.join(least, "label").select(F.col("_key").alias(key), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = 12, miss: float = 0.01, spare_bits: int = 7, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """One row of each component of similar documents: that of the smallest key, a null key last, then the first in its file."""
    found, rows, at = similar_rows(docs, key, text, shingle, similarity, width, miss, spare_bits, last_pairs)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", at)).alias("first"), F.count("*").alias("n")).where("n > 1")
    drop = materialise(found.join(first, "label").where(F.col(at) != F.col(f"first.{at}")).select(at), "near-dropped")
    return keep_matching(rows, drop, [at], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
