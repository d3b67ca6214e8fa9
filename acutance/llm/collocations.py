"""Phrase collocation mining (operator 13): suffixes of words, parted vertically by their prefixes into groups of bounded size.

Documents are packed into chunks. A chunk asks shards of words about its distinct words with their counts; a shard sums
them, gives each frequent word a number and parts the prefixes: words are packed into groups until a group would hold
more than `budget` suffixes. A word that begins more suffixes than that is a prefix too short: it gets several groups, among
which its suffixes are dealt by their second word, and where that one is such a word, too, by the third. So each
group is the set of suffixes of some prefixes, bounded by the budget, and however common a word is, its suffixes never
meet in one task.

A chunk cuts the suffixes that begin at its words to three words, ending them early at the end of a piece and before a word
that is too rare for any phrase, adds equal ones up and sends each group its own. A group sorts what all chunks have sent:
its suffix subtrees, cut off at depth three, where equal neighbours are one leaf. Sums of leaves are the counts of
phrases; those of two split words are parts, which are added up afterwards. Phrases that occur too seldom never
leave their group.

A null lang is `und`, a null text is empty. Repeated rows count each time. Empty tables give empty results. Counts are
64-bit; scores are computed in decimals of 38 digits, so counts may reach 10^16. Words are compared as bytes, not as hashes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acutance.llm.chunks import ask_with_sums, dealt, make_chunks, squeeze, unsqueeze
from acutance.llm.common import RollingHash, lower_ascii, mix64, tidy, trim
from acutance.llm.terms import BREAK, WORD, byte_kinds, from_raw, picked, raw_values, runs_of, values_of
from acutance.session import materialise

#: Words end at a blank or a tab, pieces at these marks and at line ends.
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
UNKNOWN_LANG = "und"
CHUNK_BYTES, SHARD_BYTES, BUDGET = 4 << 20, 32 << 20, 1 << 19
SALTS = 16


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of many texts, the row of each and the number of its piece."""
    lower = lower_ascii(data)
    kinds = KINDS[lower]
    mask = kinds == WORD
    starts, ends, rows = runs_of(mask, offsets)
    breaks = np.cumsum(kinds == BREAK, dtype=np.int64)
    return values_of(lower, mask, starts, ends), rows, (breaks[starts] if len(starts) else starts) + rows


class Words:
    """A chunk's words in order and its distinct pairs of lang and word, as they are sent to the shards."""

    def __init__(self, row: dict, shards: int):
        data, offsets = unsqueeze(row["body"])
        values, rows, self.piece = words_of(data, offsets)
        self.langs = sorted(set(row["keys"]))
        number = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([number[x] for x in row["keys"]], np.int64)[rows]
        coded = values.dictionary_encode()
        n = max(1, len(coded.dictionary))
        keys, self.at, self.count = np.unique(lang * n + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        self.lang, self.word, self.texts = keys // n, keys % n, coded.dictionary
        raw, at = raw_values(self.texts)
        salt = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        hashes = mix64(RollingHash(raw).of(at[:-1], at[1:])[self.word] ^ salt[self.lang]) if len(keys) else np.zeros(0, np.uint64)
        self.shards = dealt((hashes % np.uint64(shards)).astype(np.int64), shards)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        names = np.frombuffer(json.dumps(self.langs).encode(), np.uint8)
        for s, own in enumerate(self.shards):
            if len(own):
                data, lengths = picked(self.texts, self.word[own])
                yield s, squeeze(np.array([s], np.int64), names, self.lang[own].astype(np.uint32), lengths, data, self.count[own].astype(np.uint64))


def _slim(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def part_prefixes(totals: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each word: long ones have groups of their own, the others share them in their order."""
    parts = np.maximum(1, -(-totals // budget))
    long = parts > 1
    group = np.zeros(len(totals), np.int64)
    group[long] = np.cumsum(parts[long]) - parts[long]
    sums = np.cumsum(totals[~long])
    group[~long] = parts[long].sum() + (sums - totals[~long]) // budget
    return group, parts


def count_words(payloads: list[bytes], shards: int, least: int, budget: int) -> list[bytes]:
    """Answers of one shard of words: number, first group and number of groups of each frequent word (number 0: too rare); and the shard's table of words."""
    asked = [unsqueeze(p) for p in payloads]
    shard = int(asked[0][0][0])
    names = [json.loads(a[1].tobytes()) for a in asked]
    langs = sorted({x for own in names for x in own})
    number = {x: i for i, x in enumerate(langs)}
    lang = np.concatenate([np.array([number[x] for x in own], np.int64)[a[2]] for own, a in zip(names, asked, strict=True)])
    lengths = np.concatenate([a[3] for a in asked]).astype(np.int64)
    coded = from_raw(np.concatenate([a[4] for a in asked]), np.concatenate(([0], np.cumsum(lengths)))).dictionary_encode()
    n = max(1, len(coded.dictionary))
    keys, back = np.unique(lang * n + coded.indices.to_numpy(), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([a[5] for a in asked]).astype(float), minlength=len(keys)).astype(np.int64)
    frequent = np.flatnonzero(total >= least)
    frequent = frequent[np.argsort(-total[frequent], kind="stable")]
    ids, group, parts = (np.zeros(len(keys), np.int64) for _ in range(3))
    ids[frequent] = 1 + np.arange(len(frequent)) * shards + shard
    local, parts[frequent] = part_prefixes(total[frequent], budget)
    group[frequent] = local * shards + shard
    answers = [squeeze(_slim(ids[at]), _slim(group[at]), _slim(parts[at])) for at in np.split(back, np.cumsum([len(a[2]) for a in asked])[:-1])]
    data, word_lengths = picked(coded.dictionary, keys[frequent] % n)
    per_lang = np.bincount(keys // n, weights=total.astype(float), minlength=len(langs)).astype(np.int64)
    table = squeeze(np.frombuffer(json.dumps(langs).encode(), np.uint8), per_lang, (keys[frequent] // n).astype(np.int64), word_lengths, data, ids[frequent], total[frequent])
    return [*answers, table]


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("answer"):
            names, _, lang, lengths, data, ids, total = unsqueeze(value.as_py())
            langs = pa.array(json.loads(names.tobytes()), pa.string())
            words = from_raw(data, np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), langs.take(pa.array(lang)), words, pa.array(total)], ["id", "lang", "word", "f"])


def _read_langs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("answer"):
            names, totals = unsqueeze(value.as_py())[:2]
            yield pa.RecordBatch.from_arrays([pa.array(json.loads(names.tobytes()), pa.string()), pa.array(totals)], ["lang", "n"])


def suffixes_of(words: Words, answers: dict[int, list[np.ndarray]], shards: int) -> Iterator[tuple[int, bytes]]:
    """(group, payload): the distinct suffixes of a chunk, cut to three words, with their counts and whether their first two words are split."""
    ids, group, parts = (np.zeros(len(words.count), np.int64) for _ in range(3))
    for s, own in enumerate(words.shards):
        if len(own):
            ids[own], group[own], parts[own] = answers[s]
    order = np.lexsort((ids, group))
    order = order[ids[order] > 0]
    n = len(order)
    code = np.full(len(ids), -1, np.int64)
    code[order] = np.arange(n)
    c = code[words.at]
    if len(c) < 2:
        return
    pair = np.zeros(len(c), bool)
    pair[:-1] = (words.piece[1:] == words.piece[:-1]) & (c[1:] >= 0) & (c[:-1] >= 0)
    at = np.flatnonzero(pair)
    if not len(at):
        return
    third = np.where(pair[at + 1], c[np.minimum(at + 2, len(c) - 1)] + 1, 0)
    if n < 1 << 20:
        leaf, count = np.unique((c[at] * n + c[at + 1]) * (n + 1) + third, return_counts=True)
        both, third = leaf // (n + 1), leaf % (n + 1)
    else:
        twos, back = np.unique(c[at] * n + c[at + 1], return_inverse=True)
        leaf, count = np.unique(back * (n + 1) + third, return_counts=True)
        both, third = twos[leaf // (n + 1)], leaf % (n + 1)
    a, b = order[both // n], order[both % n]
    one, two, three = ids[a], ids[b], np.where(third > 0, ids[order[third - 1]], 0)
    split = (parts[a] > 1) & (parts[b] > 1)
    by_two = mix64(two.astype(np.uint64))
    turn = np.where(split, mix64(by_two + three.astype(np.uint64)) % np.minimum(parts[a], parts[b]).astype(np.uint64), by_two % parts[a].astype(np.uint64))
    to = group[a] + turn.astype(np.int64) * shards
    rank = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], to[rank][1:] != to[rank][:-1])))
    for own in np.split(rank, first[1:]):
        yield int(to[own[0]]), squeeze(_slim(one[own]), _slim(two[own]), _slim(three[own]), _slim(count[own]), split[own])


def subtree(payloads: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Nodes of a group's suffix subtrees at depth two (third word 0) and three that occur often enough: words, count, and whether the count is a part."""
    got = [unsqueeze(p) for p in payloads]
    one, two, three, count = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in range(4))
    split = np.concatenate([g[4] for g in got])
    order = np.lexsort((three, two, one))
    one, two, three, count, split = (x[order] for x in (one, two, three, count, split))
    new_pair = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    leaf, node = np.flatnonzero(new_pair | np.concatenate(([True], three[1:] != three[:-1]))), np.flatnonzero(new_pair)
    leaves, nodes = np.add.reduceat(count, leaf), np.add.reduceat(count, node)
    keep_leaf, keep_node = (leaves >= least) & (three[leaf] > 0), (nodes >= least) | split[node]
    at = np.concatenate((node[keep_node], leaf[keep_leaf]))
    third = np.concatenate((np.zeros(keep_node.sum(), np.int64), three[leaf[keep_leaf]]))
    return one[at], two[at], third, np.concatenate((nodes[keep_node], leaves[keep_leaf]))


def count_phrases(docs: DataFrame, lang: str, text: str, least: int, budget: int, chunk_bytes: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id1, id2, id3, a): counts of phrases of two words (id3 0) and three; (id, lang, word, f): the frequent words; (lang, n)."""
    kept = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text).alias("text"))
    chunks = make_chunks(kept, "lang", "text", chunk_bytes, "phrase-chunks")
    shards = max(1, (chunks.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes)
    asked, own = ask_with_sums(chunks, lambda row: Words(row, shards).questions(), lambda p: count_words(p, shards, least, budget), "phrase-words", ["chunk", "keys", "body"])

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].as_py() for f in ("keys", "body", "answers")}
                answers = {a["shard"]: unsqueeze(a["answer"]) for a in row["answers"] or []}
                out = list(suffixes_of(Words(row, shards), answers, shards))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["group", "payload"])

    def grow(group: pa.Table) -> pa.Table:
        nodes = subtree([x.as_py() for x in group["payload"]], least)
        trim()
        return pa.table(dict(zip(("id1", "id2", "id3", "a"), nodes, strict=True)))

    sent = asked.select("keys", "body", "answers").mapInArrow(send, "group long, payload binary")
    nodes = materialise(sent.groupBy("group").applyInArrow(grow, "id1 long, id2 long, id3 long, a long"), "phrase-nodes")
    counts = nodes.groupBy("id1", "id2", "id3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    words = own.mapInArrow(_read_words, "id long, lang string, word binary, f long").withColumn("word", F.col("word").cast("string"))
    langs = own.mapInArrow(_read_langs, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return materialise(counts, "phrase-counts"), materialise(words, "phrase-vocabulary"), langs


def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a table that has a row for each key; rows of a common key are spread over SALTS tasks.

    Spark sizes the copies of right like one of them, and its file by compressed bytes, so it would broadcast millions of rows: the join is always by sorting.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    dealt_rows = left.withColumn("_salt", F.pmod(F.xxhash64("id1", "id2", "id3"), F.lit(SALTS)).cast("int"))
    return dealt_rows.join(spread, [*on, "_salt"], "left").drop("_salt")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    num = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", num.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, share: int = 50, top: int = 2000, budget: int = BUDGET, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each lang, those inside a longer one of share % of their count left out."""
    counts, words, langs = count_phrases(docs, lang, text, least, budget, chunk_bytes, shard_bytes)
    pairs, triples = counts.where("id3 = 0"), counts.where("id3 > 0")
    known = pairs.select("id1", "id2", F.col("a").alias("f12"))
    later = known.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("f12").alias("f23"))
    longer = triples.select("id1", "id2", "a").unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))
    longer = longer.groupBy("id1", "id2").agg(F.max("a").alias("most")).hint("merge")  # never broadcast, like the copies in matched
    inside = F.coalesce(F.lit(100).cast("decimal(3,0)") * F.col("most").cast("decimal(19,0)") >= F.lit(share).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)"), F.lit(False))
    two = pairs.join(longer, ["id1", "id2"], "left").where(~inside).select("id1", "id2", "id3", "a", F.lit(None).cast("long").alias("f12"), F.lit(None).cast("long").alias("f23"))
    three = matched(matched(triples, known, ["id1", "id2"]), later, ["id2", "id3"]).select("id1", "id2", "id3", "a", "f12", "f23")
    found = two.unionByName(three)
    for i in (1, 2, 3):
        found = matched(found, words.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else [])), [f"id{i}"])
    cuts = lambda left, right: F.struct(score_of(F.col("a"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    one, other = cuts("f1", "f23"), cuts("f12", "f3")
    best = F.when(F.col("id3") == 0, cuts("f1", "f2")).when(one["score"] <= other["score"], one).otherwise(other)
    rows = found.withColumn("cut", best).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
