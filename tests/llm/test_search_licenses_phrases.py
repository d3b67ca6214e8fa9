"""Lexical search, licence scans and phrase mining against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acutance.llm import collocations, lexical, licenses
from acutance.session import read_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
DOCS = [
    (1, "Hello there WORLD hello", "en"), (2, None, None), (3, "", "en"), (4, "the GNU General Public License, the gnu general-public license", "en"),
    (5, " ".join(f"w{i * i % 101} of the x{i % 7}" for i in range(60_000)), "en"), (6, NOTICE, "en"), (7, "CC BY-NC 4.0; cc by. MIT\tLicense é①", None), (7, "CC BY-NC 4.0; cc by. MIT\tLicense é①", None),
    (None, "hello world of the cc", "de"), (8, "gnu general public", "de"), (9, "hello world of the cc", "de"), *((20 + i, "of the x of the\x0bof the, x of! the x1 x2 x3 x1 x2", "und" if i % 2 else "fr") for i in range(12)),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    clashing = {c: F.lit("x") for c in ("score", "key", "id", "rank", "a", "group", "word", "matches", "_salt", "_metadata", "shard")}
    return spark.createDataFrame(DOCS, SCHEMA).withColumns(clashing).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return TERM.findall((text or "").translate(LOW))


# 11


def best(docs, items, k):
    held = [(key, terms(text)) for key, text in docs]
    held = [(key, Counter(t), len(t)) for key, t in held if t]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, own, _ in held for t in own)
    out = []
    for item, text in items:
        wanted = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        scores = []
        for key, own, size in held:
            m = 50 + 50 * size * n // length
            s = sum(w * (1_000_000_000 * own[t] // (1000 * own[t] + 20 * m)) for t, w in wanted.items() if t in own)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "Hello, the MIT license"), (2, None), (3, "..."), (4, "nothing-held"), (5, "of THE w1 w4 x3 gnu"), (5, "of THE w1 w4 x3 gnu"), (None, "cc é①")]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 2, "block_terms": 8, "block_rows": 1, "k": 3}, {"shard_rows": 5, "block_terms": 30, "block_rows": 2, "k": 1}])
def test_search_equals_brute_force(spark, docs, sizes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.search(docs, items, **sizes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == best([d[:2] for d in DOCS], ITEMS, sizes.get("k", 50))


def test_search_of_whole_tables_in_small_parts(spark):
    sf = "/root/testdata/sf0.001"
    d, b = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    found = lexical.search(d, b, k=7, shard_rows=16, block_terms=300, block_rows=4)
    want = best([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()], 7)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_search_skips_blocks():
    """A list's blocks of documents unlike the query stay unscored, and no better document is lost."""
    rng = np.random.default_rng(1)
    n, near = 2000, 40
    counts = np.concatenate((np.full(near, 6), np.full(n - near, 2)))
    codes = np.concatenate([np.r_[0, 1, 2, 3, 4, 5] if i < near else np.r_[0, 6 + rng.integers(50)] for i in range(n)])
    tf = rng.integers(1, 5, len(codes))
    body = lexical.squeeze(np.full(n, 30, np.uint32), counts.astype(np.uint32), codes.astype(np.uint32), tf.astype(np.uint32))
    weight = np.full(56, 900, np.int64)
    axes = rng.choice([-1.0, 1.0], (56, lexical.PROJECTIONS))
    shard = lexical.Shard(body, list(range(n)), n, 30 * n, weight, axes, 32)
    scored, gather = [], np.ix_
    lexical.np.ix_ = lambda a, b: scored.append(len(a)) or gather(a, b)
    try:
        score, found = shard.search([0, 1, 2, 3, 4, 5], weight, 10, 0)
    finally:
        lexical.np.ix_ = gather
    every = shard.impacts[:, :6].astype(float) @ weight[:6]
    assert score.tolist() == sorted(every, reverse=True)[:10] and (every[found] == score).all()
    assert sum(scored) < n / 4
    for column in range(6):
        rows, bounds, summary = shard.blocks(column)
        for b in range(len(bounds) - 1):
            assert (summary[b] == shard.impacts[rows[bounds[b] : bounds[b + 1]]].max(axis=0)).all()


def test_search_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0


# 12


def scanned(text):
    ws = terms(text)
    base, labels, base_labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        for s in range(-len(t.words), len(ws)):
            at = lambda q: 0 <= s + q < len(ws) and ws[s + q] == t.words[q]  # noqa: B023, E731
            share = sum(at(q) for q in range(len(t.words))) / len(t.words)
            if all(at(q) for lo, hi in t.spans() for q in range(lo, hi)) and share >= t.share:
                labels.add(t.label)
                score = max(score, share)
                if t.base:
                    base.append(s)
                    base_labels.add(t.label)
    return len(ws), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def test_scan_equals_brute_force(docs):
    found = licenses.scan(docs)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    got = sorted((tuple(r)[:-1] for r in found.collect()), key=str)
    assert got == sorted(((d[0], *scanned(d[1])) for d in DOCS), key=str)
    row = next(r for r in found.collect() if r.doc_id == 6)
    assert row.labels == "apache,apache-2.0" and {(m.label, m.word) for m in row.matches} >= {("apache", 3)}


def test_scan_ends_and_partial_templates(spark):
    texts = ["cc by", "by cc", "cc", "x cc by nc", "version 3 gnu general public license version 3", "gnu general public license", "permission is hereby granted free of charge to any person"]
    full = next(t.text for t in licenses.NOTICES if t.label == "mit")
    texts += [full, full.replace("any person", "any people"), " ".join(full.split()[:-2]), "mit license " * 600]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:-1] for r in licenses.scan(d).collect()}
    assert got == {i: scanned(t) for i, t in enumerate(texts)}
    assert got[10][1] == 600 and got[7][5] == "mit" and got[9][5] == ""


def test_scan_anchor_is_the_rarest_word(spark):
    d = spark.createDataFrame([(i, "by " * i) for i in range(1, 30)] + [(99, "cc by")], "doc_id long, text string")
    vocab = licenses.vocabulary(licenses.TEMPLATES)
    idf = licenses.idf_of(licenses.index_files(d, vocab), len(vocab))
    scanner = licenses.Scanner(licenses.TEMPLATES, vocab, idf)
    assert idf[vocab.index("cc")] > idf[vocab.index("by")] and scanner.anchor[[t.label for t in licenses.TEMPLATES].index("cc-by")] == 0


def test_scan_of_empty_tables(none):
    assert licenses.scan(none).count() == 0


# 13


def mined(rows, least, share, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, count in f.items():
        phrases, most, rows = {p: a for p, a in count.items() if len(p) > 1 and a >= least}, Counter(), []
        for p, a in phrases.items():
            for q in (p[:2], p[1:]) if len(p) == 3 else ():
                most[q] = max(most[q], a)
        for p, a in phrases.items():
            if len(p) == 3 or not most[p] or 100 * most[p] < share * a:
                s, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"budget": 25_000, "chunk_bytes": 200_000, "shard_bytes": 300_000}, {"least": 3, "share": 90, "top": 5, "budget": 100_000}, {"least": 1, "share": 101}])
def test_phrases_equal_brute_force(docs, sizes):
    found = collocations.collocations(docs, **sizes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined([d[1:] for d in DOCS], sizes.get("least", 10), sizes.get("share", 50), sizes.get("top", 2000))
    assert sorted(tuple(r) for r in found.collect()) == want


def test_prefix_groups_keep_to_the_budget():
    totals = np.array([5000, 900, 700, 300, 200, 120, *[10] * 500])
    group, parts = collocations.part_prefixes(totals, 1000)
    assert parts[0] == 5 and (parts[1:] == 1).all() and group[0] == 0 and group[1:].min() == 5
    assert np.bincount(group[1:], weights=totals[1:]).max() <= 2000


def test_phrase_scores_are_exact(spark):
    wide = [(10**15, 3 * 10**15, 2 * 10**15 + 1), (10, 10, 10), (7 * 10**15, 7 * 10**15, 7 * 10**15), (11, 10**16, 13)]
    d = spark.createDataFrame(wide, "a long, l long, r long").select("a", "l", "r", collocations.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in d.collect())


def test_phrases_of_empty_tables(spark, none):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " ", "en")], SCHEMA)).count() == 0


def test_copies_of_a_table_are_never_broadcast(spark):
    left = spark.range(50).select(F.col("id").alias("id1"), F.lit(1).alias("id2"), F.lit(0).alias("id3"))
    right = spark.range(30).select(F.col("id").alias("id1"), (F.col("id") * 2).alias("f"))  # under any limit before it is copied
    found = collocations.matched(left, right, ["id1"])
    assert {r.id1: r.f for r in found.collect()} == {i: 2 * i if i < 30 else None for i in range(50)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
