"""Each corpus operator against a brute-force version on small fixtures with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from acutance.llm import balltree, chat, common, exact, mixing, ngrams, pieces, quality, queries, simhash, suffixes, urls
from acutance.session import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(20_000))
BASE = " ".join(f"w{i * i % 101}" for i in range(120))
DOCS = [
    (1, "Hello there\tWORLD  hello", "b", "en"), (2, "hello there world hello", "b", "en"), (3, None, "a", None), (4, "", None, "en"), (5, " \n\t", "a", "en"),
    (6, LONG, "c", "en"), (7, BASE, "c", "en"), (8, BASE, "c", "en"), (9, BASE + " extra", None, "de"), (10, "é①😀 ▁x  y", "a", "fr"), (10, "é①😀 ▁x  y", "a", "fr"),
    (11, "hello  there world hello", "d", "en"), (None, "no id at all", "d", "en"), (12, "one", "d", "en"), (13, BASE.replace("w4 ", "q4 "), "d", "en")]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with result columns
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"score": F.lit("x"), "size": F.lit(1), "fp": F.lit("f"), "n_tokens": F.lit("t"), "digest": F.lit(0)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


# 1


def test_mix_targets_cap_and_reshare():
    t = mixing.targets(np.array([10, 100, 1000]), np.array([5, 2, 1]))
    assert t.tolist() == [30, 300, 780]
    assert mixing.targets(np.array([0, 5]), np.array([5, 2])).tolist() == [0, 5]


def test_mix_tree_and_permutation():
    d = mixing.split_tree(np.array([10, 20, 5]), 7, 3)
    assert d.sum(axis=0).tolist() == [10, 20, 5] and (d >= 0).all() and (mixing.split_tree(np.array([10, 20, 5]), 7, 3) == d).all()
    assert set(d.sum(axis=1)) == {5}
    for n in (1, 2, 7, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9)) == list(range(n))
    two = mixing.permuted(np.tile(np.arange(40), 2), np.full(80, 40), np.repeat([3, 4], 40))
    assert sorted(two[:40]) == sorted(two[40:]) == list(range(40)) and (two[:40] != two[40:]).any()


@pytest.mark.parametrize("size", [5, 700, 5_000, 300_007])
def test_mix_plan_draws_what_the_tree_says(size):
    rows = [("a", size), ("b", 3 * size + 1), ("c", 40 * size), (None, 0)]
    plans = mixing.plan_sources(rows, lambda i: (5, 2, 1)[i % 3], 6, 7, 16, 3.0)
    for plan in plans:
        total = 0
        for p in range(plan.passes):
            shard, turn, take = plan.words(np.arange(plan.blocks), p)
            assert (np.bincount(shard, minlength=plan.need.shape[1]) == plan.pool[p]).all()
            full = plan.cut == 0 or p < plan.passes - 1
            assert not full or (np.bincount(shard[take > 0], minlength=plan.need.shape[1]) == plan.need[p]).all()
            for s in set(shard):
                assert sorted(turn[shard == s]) == list(range(plan.pool[p][s]))
            total += take.sum()
        assert abs(total - plan.target) <= 1
    draws = sum(plan.need.sum(axis=0) for plan in plans)
    assert draws.max() - draws.min() <= 1


def test_mix_follows_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(3 + i % 7)), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    take = lambda: sorted((r.doc_id or 0, r.taken) for r in mixing.mix(docs, shards=4).collect())
    first, split = take(), mixing.split_tree
    assert first == take()
    monkeypatch.setattr(mixing, "split_tree", lambda draws, shards, seed: split(draws, shards, seed)[::-1] if seed % 2 else split(draws, shards, seed + 5))
    assert first != take()


def test_mix(docs, none):
    rows = mixing.mix(docs, block_words=16, shards=4).collect()
    again = mixing.mix(docs.repartition(5), block_words=16, shards=4).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in rows) == sorted((r.doc_id or 0, r.taken) for r in again)
    assert len(rows) == len(DOCS)
    size = Counter()
    for _, text, source, _ in DOCS:
        size[source] += len(WORD.findall(text or ""))
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == size[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets(np.array([size[s] for s in order]), np.array([(5, 2, 1)[i % 3] for i in range(len(order))]))
    for s, g in zip(order, goal):
        assert target[s] == pytest.approx(g) and abs(taken[s] - g) <= 1
    # no word of a document is drawn twice in a pass
    for r in rows:
        seen = Counter()
        for s in r.spans:
            for w in range(s["first_word"], s["first_word"] + s["words"]):
                seen[s["pass"], w] += 1
        assert not seen or max(seen.values()) == 1
    assert mixing.mix(none).count() == 0


def test_mixed_documents(docs):
    """Ids repeat and are null here: the words written are the words taken, and a row's words come from its own text."""
    ids = docs.withColumn("doc_id", F.when(F.col("doc_id") < 6, F.col("doc_id") % 2)).unionByName(docs)
    out = mixing.mixed_documents(ids, block_words=16, shards=3)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == sum(r.taken for r in mixing.mix(ids, block_words=16, shards=3).collect())
    known = {w for d in DOCS for w in WORD.findall(d[1] or "")}
    assert all(set(WORD.findall(r.text)) <= known for r in rows)


def test_mixed_documents_are_sorted_in_their_shards(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(3 + i % 5)), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    where = {(r.doc_id, s["pass"]): (s["shard"], s["position"]) for r in mixing.mix(docs, shards=5).collect() for s in r.spans[::-1]}
    parts = mixing.mixed_documents(docs, shards=5).withColumn("p", F.spark_partition_id()).collect()
    shards = {}
    for r in parts:
        found = {where[r.doc_id, p][0] for p in range(3) if (r.doc_id, p) in where}
        shards.setdefault(r.p, []).append(found)
    assert len(parts) > 200 and all(shards.values())


# 2


def test_quality_learns_and_scores(spark, docs, none):
    train = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    w = quality.train_from_labels(train, labels)
    held = quality.score(train, w).join(labels, "doc_id").where(quality.fold(F.col("doc_id"), 3) == 1)
    right = held.where((F.col("predicted") == F.col("quality"))).count()
    assert right / held.count() > 0.97
    got = quality.score(docs, w).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not WORD.search(r.text or "")}
    assert len(empty) == 1 and empty.pop() == pytest.approx(1 / (1 + math.exp(-w[-1])))
    assert quality.score(none, w).count() == 0
    flat = quality.train(none.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    assert not flat.any() and {r.score for r in quality.score(docs, flat).collect()} == {0.5}


# 3


def brute_fingerprint(text, k=3):
    w = words(text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if low[b] < low[a] and linked(a, b):
                    low[a], changed = low[b], True
    return low


def test_simhash(docs, none):
    docs = docs.where("doc_id is not null")
    got = simhash.near_duplicates(docs).withColumn("h", simhash.hex16()).collect()
    fp = {d[0]: brute_fingerprint(d[1]) for d in DOCS if d[0] is not None}
    low = components_of(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert len(got) == len(DOCS) - 1
    for r in got:
        assert r.h == f"{fp[r.doc_id]:016x}" and r.component_id == low[r.doc_id]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("file_rows", [1, 64])
def test_simhash_links_exactly(spark, file_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            fps.add(int(b) ^ sum({1 << int(i) for i in rng.integers(0, 62, rng.integers(1, 4))}))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {r.node: r.label for r in simhash.components(simhash.links(df, file_rows=file_rows)).collect()}
    low = components_of(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = Counter(low.values())
    for x in fps:
        if groups[low[x]] > 1:
            assert found[x] == low[x]
        else:
            assert x not in found


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_similar_documents_find_near_copies(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for i in range(60):
        w = [f"t{x}" for x in rng.integers(0, 50_000, 200)]
        rows.append((2 * i, " ".join(w)))
        for p in rng.integers(0, 200, 2):
            w[p] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
        truth[2 * i + 1] = 2 * i
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 58
    assert all(got[2 * i] == 2 * i for i in range(60))


def _shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _brute_components(rows, similarity=0.8):
    sets, top = [_shingled(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                top[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def _changed(rng, words, n):
    words = list(words)
    for p in rng.choice(len(words) - 60, n, replace=False):
        words[p] = f"c{rng.integers(1 << 40)}"
    return words


def test_similar_documents_in_large_files(spark):
    """Pairs of copies, and two groups of more than 64, whose files are full of other texts from one template."""
    rng = np.random.default_rng(5)
    template = [f"t{x}" for x in range(240)]
    own = lambda: template + [f"o{x}" for x in rng.integers(0, 1 << 40, 60)]
    texts = [own() for _ in range(160)]
    for _ in range(40):
        texts.append(own())
        texts.append(_changed(rng, texts[-1], 4))
    for _ in range(2):
        base = own()
        texts += [_changed(rng, base, 2) for _ in range(70)]
    rows = [(i, " ".join(texts[j])) for i, j in enumerate(rng.permutation(len(texts)))]
    # few blocks of few bits, so that files are large; rounds without end, so that hubs alone don't do it
    for last_pairs in (1, 10**6):
        got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=4, spare_bits=-1, last_pairs=last_pairs).collect()
        assert {r.doc_id: r.component_id for r in got} == _brute_components(rows)


def test_similar_documents_in_hot_files(spark, monkeypatch):
    """A third of all rows are near copies; the files they fill are dealt to parts."""
    monkeypatch.setattr(simhash, "HOT_ROWS", 64)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    monkeypatch.setattr(simhash, "PART_ROWS", 40)
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    base = fresh(200)
    texts = [_changed(rng, base, 1 + i % 12) for i in range(300)] + [fresh(150) for _ in range(600)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _brute_components(rows)
    wrong = [r.doc_id for r in got if r.component_id != want[r.doc_id]]
    assert len(got) == len(rows) and len(wrong) <= 3 and len(set(want.values())) > 600


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_at_the_limit(spark, similarity):
    """Pairs whose similarity lies at most 0.02 above: the formula promises 0.99 at 0.8, and pairs below are never linked."""
    rng = np.random.default_rng(11)
    rows, alike = [], []
    for _ in range(400):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        other = _changed(rng, base, rng.integers(1, 11))
        a, b = _shingled(" ".join(base)), _shingled(" ".join(other))
        alike.append(len(a & b) / len(a | b))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(400)]
    assert not any(f for f, s in zip(found, alike) if s < 0.8 - 1e-9)
    near = [f for f, s in zip(found, alike) if similarity <= s + 1e-9 and s < similarity + 0.05]
    assert len(near) >= 20 and sum(near) >= 0.95 * len(near)


def test_similar_documents_with_nulls_repeats_and_clashes(spark, docs, none):
    got = simhash.similar_documents(docs).collect()
    assert len(got) == len(DOCS)
    low = {}
    for r in got:
        low.setdefault(r.component_id, set()).add(r.doc_id)
    assert low[3] == {3, 4, 5} and low[7] >= {7, 8, 9} and low[10] == {10} and low[None] == {None}
    assert simhash.similar_documents(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_near_dedup_keeps_every_row_that_is_no_copy(spark):
    rng = np.random.default_rng(12)
    one, two = ([f"w{x}" for x in rng.integers(0, 1 << 40, 100)] for _ in range(2))
    rows = [(1, " ".join(one)), (2, " ".join(one[:99])), (2, " ".join(two)), (None, " ".join(two[:99])), (None, "some text of its own here"), (None, None), (3, ""), (3, "")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.lit(1)))
    assert out.columns == ["doc_id", "text", "_at"]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, rows[0][1]), (2, rows[2][1]), (0, rows[4][1]), (3, "")])


def test_similar_documents_are_exact_round_the_limit(spark):
    """Similarities of 0.65 to 0.95, and texts that have nothing in common but a line that each repeats."""
    rng = np.random.default_rng(7)
    rows, line = [], " ".join(f"r{x}" for x in range(12))
    for i in range(150):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        repeated = [line] * 30 if i % 3 == 0 else []
        rows.append((2 * i, " ".join(base + repeated)))
        rows.append((2 * i + 1, " ".join(_changed(rng, base, 2 + i % 11) + repeated)))
    rows += [(1000 + i, " ".join([line] * 50 + [f"z{x}" for x in rng.integers(0, 1 << 40, 40)])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _brute_components(rows)
    assert len(set(want.values())) < len(rows) - 50
    assert got == want


# 4


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, none, weak):
    digest = (lambda c: F.lit("same")) if weak else exact.sha256
    got = exact.exact_groups(docs, digest=digest, max_bytes=1).collect()
    groups = {}
    for d, t, *_ in DOCS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    expect = Counter()
    for g in groups.values():
        keep = min(g)[2]
        for _, _, d in g:
            expect[d, keep, len(g)] += 1
    assert Counter((r.key, r.keep_key, r.group_size) for r in got) == expect
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_groups(none, digest=digest).count() == 0


def test_exact_keeps_one_of_each(docs):
    assert exact.deduplicate(docs).count() == len({re.sub(r"[\x20\x09-\x0D]", "", d[1] or "") for d in DOCS})


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_keeps_every_text_where_ids_repeat(spark, weak):
    rows = [(1, "alpha text"), (2, "alpha text"), (2, "a unique text of its own"), (3, "more"), (None, "more"), (None, "only here"), (4, None), (4, " "), (5, "x y"), (5, "x y")]
    digest = (lambda c: F.lit("same")) if weak else exact.sha256
    out = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "locator": F.lit("x")}), digest=digest)
    assert out.columns == ["doc_id", "text", "digest", "locator"]
    got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in out.collect())
    assert got == sorted([(1, "alpha text"), (2, "a unique text of its own"), (3, "more"), (0, "only here"), (4, ""), (5, "x y")])


def test_exact_goes_on_where_it_ended(spark, docs, tmp_path):
    """Two runs over new files give what one run gives."""
    folder = f"file://{tmp_path}/index"
    half = [docs.where(F.xxhash64("text") % 3 == 0), docs.where(F.coalesce(F.xxhash64("text") % 3 != 0, F.lit(True)))]
    for part in half:
        got = exact.exact_groups(part.select("doc_id", "text"), folder=folder, max_bytes=1).collect()
    one = exact.exact_groups(docs).collect()
    key = lambda r: (r.key or 0, r.keep_key or 0, r.group_size, r.kept, r.digest)
    assert sorted(map(key, got)) == sorted(map(key, one)) and len(got) == len(DOCS)
    assert exact.exact_groups(docs.select("doc_id", "text").limit(0), folder=folder).count() == len(DOCS)


# 5


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [1e30, float("inf")]), (404, [0.5, 0.25]), (50, [0.5] * 8), (0, [0.25] * 8)]
    rows += [(405 + i, rows[7][1]) for i in range(6)]
    got = balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=60, leaf_rows=4, block_rows=3).collect()
    v = []
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            y = [math.floor(256 * float(np.float32(c))) for c in x]
            v.append((i, y + [0] * (8 - len(y))))
    expect = Counter()
    for n, (i, x) in enumerate(v):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in v if j != i)[:5]
            for k, (s, j) in enumerate(best):
                expect[i, k + 1, j, -s] += 1
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expect
    few = balltree.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"))
    assert few.count() == 2
    assert balltree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_leaves_far_shards_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) / 8 + 8 * np.eye(4)[i // 8 % 4]]) for i in range(800)] + [(50, [8.0, 0.0, 0.0, 0.0])] * 300
    seen, real = [], balltree.still_wanted

    def counted(order, best, queries, done, width, k):
        out = real(order, best, queries, done, width, k)
        seen.append((order.where(F.col("i").between(done, done + width - 1)).count(), out.count()))
        return out

    monkeypatch.setattr(balltree, "still_wanted", counted)
    got = balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=40, leaf_rows=4, block_rows=5).collect()
    assert sum(kept for _, kept in seen) < 0.8 * sum(every for every, _ in seen), seen
    v = [(i, np.floor(256 * np.float32(x).astype(float)).astype(int)) for i, x in rows]
    expect = Counter()
    for i, x in v:
        if i % 50 == 0:
            for rank, (s, j) in enumerate(sorted((-int(x @ y), j) for j, y in v if j != i)[:5]):
                expect[i, rank + 1, j, -s] += 1
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expect


# 6


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "early"), (2, 0, "system", "alone"), (None, 5, "ann", "x"), (3, 300, "u", "late"), (3, 1, "v", "soon")]
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "ann", 0), (3, "u", 0), (3, "u", 1), (3, "v", 0), (3, "v", 1)}
    r = got[1, "bob", 0]
    assert r.rendered == "<|user|>unknown\nearly<|end|>\n<|system|>\nbe kind<|end|>\n<|user|>ann\nhi<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r.rendered[m.start : m.end] for m in r["mask"]] == ["<|end|>", "<|end|>"]
    assert [got[1, "ann", 0].rendered[m.start : m.end] for m in got[1, "ann", 0]["mask"]] == ["hi<|end|>"]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 7


def test_trie_and_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (500, 501), (3000, 1 << 40)):
        x = np.sort(rng.integers(0, top, n))
        ef = ngrams.EliasFano(ngrams.EliasFano.build(x, top))
        assert (ef.at(np.arange(n)) == x).all()
    k = np.unique((rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 1 << 32, 3000).astype(np.uint64))
    c = rng.integers(1, 10**6, len(k))
    trie = ngrams.Trie(ngrams.map_from_file(ngrams.Trie.build(k, c)))
    assert (trie.lookup(k) == ngrams.code_of(c)).all()
    other = np.setdiff1d(k + np.uint64(1), k)
    assert not trie.lookup(other).any()
    assert (np.abs(ngrams.count_of(ngrams.code_of(c)) / c - 1) < 0.05).all()


def test_lm_scores(docs, none):
    got = ngrams.score(docs, mu=20.0, chunk_bytes=2000, shard_bytes=3000).collect()
    toks = [(d[0], words(d[1]) + ["</s>"]) for d in DOCS]
    u, b = Counter(), Counter()
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    for i, w in toks:
        if train(i):
            u.update(w)
            b.update(zip(["<s>"] + w, w))
    n, v = sum(u.values()), sum(c > 0 for c in u.values())
    p1 = lambda w: (u[w] + 0.1) / (n + 0.1 * (v + 1))
    ctx = lambda w: u["</s>"] if w == "<s>" else u[w]
    expect = sorted((i or 0, len(w), sum(u[x] > 0 for x in w), not train(i), sum(math.log10(p1(x)) for x in w), sum(math.log10((b[a, x] + 20 * p1(x)) / (ctx(a) + 20)) for a, x in zip(["<s>"] + w, w))) for i, w in toks)
    mine = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, r.base_score, r.score) for r in got)
    for a, e in zip(mine, expect, strict=True):
        assert a[:4] == e[:4] and a[4] == pytest.approx(e[4]) and a[5] == pytest.approx(e[5], rel=0.03)
    assert {r.train_tokens for r in got} == {n}
    assert ngrams.score(none).count() == 0


# 8


def test_cover_is_a_difference_cover():
    assert len({(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER}) == suffixes.V


def test_equal_means_equal_in_both_hashes():
    """Strings that agree in the first hash alone are no repeats, wherever they lie in the bucket."""
    keys = np.array([5, 5, 5, 7, 7, 9, 5], np.uint64)
    second = np.array([1, 2, 1, 3, 4, 8, 6], np.uint32)
    parts = [suffixes.squeeze(keys[:3], second[:3]), suffixes.squeeze(keys[3:], second[3:])]
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool).tolist() for x, n in zip(suffixes._repeated(parts), (3, 4))]
    assert bits == [[True, False, True], [False] * 4]
    one = [suffixes.squeeze(keys)]
    assert np.unpackbits(np.frombuffer(suffixes._repeated(one)[0], np.uint8), count=7).tolist() == [1, 1, 1, 1, 1, 0, 1]


def test_prime_hash():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    h, p = common.PrimeHash(data, 123_456_789), (1 << 31) - 1
    at = np.array([0, 100, 3000, 101, 4600])
    got = h.of(at, at + 400)
    want = [sum((int(x) + 1) * pow(123_456_789, i, p) for i, x in enumerate(data[a : a + 400])) % p for a in at]
    assert got.tolist() == want and got[1] == got[2]


def test_repeats(spark, docs, none):
    rng = np.random.default_rng(4)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    rows = [(1, text[:1500]), (2, "zz" + text[700:1100] + "yy"), (3, text[700:1099] + "y"), (4, "q" * 900), (5, text[1500:2500] + text[1500:2000]), (6, None), (7, text[2600:]), (8, text[2600:]), (9, "é" * 300), (10, "x" * 399)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs.select("doc_id", "text")):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        seen = Counter(b[p : p + 400] for _, b in rows for p in range(len(b) - 399))
        expect = []
        for i, b in rows:
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 399):
                if seen[b[p : p + 400]] > 1:
                    gone[p : p + 400] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            expect.append((i or 0, len(b), int(gone.sum()), len(edge) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
        got = suffixes.digest_columns(suffixes.repeats(df, chunk_bytes=4000)).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expect)
    assert suffixes.repeats(none).count() == 0


def test_many_copies_are_one_row_for_each_chunk(spark, monkeypatch):
    """A text with many copies is in the exchange of digests once for each chunk; all its copies lose their bytes, if long enough."""
    rng = np.random.default_rng(5)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 500)) for _ in range(6)]
    rows = [(i, texts[0] if i % 2 else ("s" * 399 if i % 3 else texts[1 + i % 5])) for i in range(400)]
    written, write = {}, suffixes.materialise

    def materialise(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(suffixes, "materialise", materialise)
    got = {r.doc_id: r for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk_bytes=20_000).collect()}
    assert len(got) == 400
    for i, t in rows:
        assert got[i].n_bytes == len(t) and bytes(got[i].kept) == (t.encode() if len(t) < 400 else b"")
    chunks = written["suffix-digests"].select("chunk").distinct().count()
    assert 4 <= chunks < 40
    assert written["suffix-digests"].groupBy("digest").count().agg(F.max("count")).first()[0] <= chunks


# 9


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://example.com/de/1"), (3, "http://foo.net"), (4, None), (5, ""), (6, "no scheme"), (7, "http://x.org/fr/#a"), (8, "http://notnet/"), (9, "http://x.net/q"), (9, "http://x.net/q"), (10, "ftp://h?x://z/a"), (None, "http://x.org/fr/9"), (11, "http://" + "a" * 5000 + ".com/")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("example.com/de/", "block") and by[3].rule is None and by[3].path == ""
    assert (by[4].host, by[4].path, by[4].rule) == ("", "", None) and by[6].host == ""
    assert by[7].rule == "org/fr/" and by[8].rule is None and by[9].rule == "net/" and (by[10].host, by[10].path) == ("h", "")
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    alone = urls.judge(spark.createDataFrame([(1, "http://q.com/")], "page_id long, url string")).first()
    assert alone.verdict == "allow"


def test_url_filter_is_native(spark):
    plan = queries.op9_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 10


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = [d[1] for d in DOCS] + ["  a  b ", "a\tb\nc", "▁", "▁▁ ▁a", "x" * 300, "<s> </s> <unk> <0x41>", "日本\x00x", " ", "e\u0301 é", "ab" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pieces.encode_decode(df, queries.model_path(), full=True).collect():
        ids = lib.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = pieces.decode(spark.createDataFrame([(lib.encode("Hello é①"),), (None,), ([],), ([1, 2, 300],)], "ids array<int>"), queries.model_path()).collect()
    assert [r.decoded for r in back] == [lib.decode(lib.encode("Hello é①")), "", "", lib.decode([1, 2, 300])]
    broken = [lib.piece_to_id("<0xE2>"), lib.piece_to_id("<0x82>"), lib.piece_to_id("<0xF0>"), *lib.encode("A")]
    odd = pieces.decode(spark.createDataFrame([(broken,), ([5, None, 10**6, -1],)], "ids array<int>"), queries.model_path()).collect()
    assert [r.decoded for r in odd] == [lib.decode(broken), lib.decode([5])]
    assert pieces.encode_decode(docs, queries.model_path()).count() == len(DOCS)
    assert pieces.encode_decode(none, queries.model_path()).count() == 0
