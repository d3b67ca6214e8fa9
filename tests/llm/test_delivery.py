"""A lasting dedup index under repeated deliveries, and tables whose columns are called as helpers and Spark's own are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from acutance.llm import exact, mixing, simhash

ROWS = [(1, "alpha beta gamma", "a"), (2, "alpha beta  gamma", "a"), (3, None, "b"), (4, "", None), (5, "delta epsilon zeta eta", "b"), (5, "delta epsilon zeta eta", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return d.withColumns({c: F.lit(i) for i, c in enumerate(("_metadata", "_spans", "_size", "_at", "_keep"))}).repartition(2)


def test_index_counts_a_file_once(spark, tmp_path):
    """A file that is delivered again, alone or with new ones, changes no group."""
    path, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/1")
    spark.createDataFrame([(6, "alpha beta gamma", "c"), (7, "theta", "c")], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/2")
    read = lambda *n: spark.read.parquet(*[f"{path}/{i}" for i in n])
    key = lambda r: (r.key, r.keep_key, r.group_size, r.kept)
    first = sorted(map(key, exact.exact_groups(read(1), folder=folder).collect()))
    again = sorted(map(key, exact.exact_groups(read(1), folder=folder).collect()))
    assert again == first == sorted(map(key, exact.exact_groups(read(1)).collect()))
    both = sorted(map(key, exact.exact_groups(read(1, 2), folder=folder).collect()))
    assert both == sorted(map(key, exact.exact_groups(read(1, 2)).collect())) and sum(k[3] for k in both) == 4
    assert sorted(map(key, exact.exact_groups(read(2), folder=folder).collect())) == both


def test_columns_called_as_helpers_are(docs):
    same = lambda df: {(r._metadata, r._spans, r._size, r._at, r._keep) for r in df.collect()} == {(0, 1, 2, 3, 4)}
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 3 and same(kept)
    near = simhash.deduplicate(docs, shingle=5, similarity=0.8)
    assert near.columns == docs.columns and same(near)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and same(mixed)
    plan = {r.doc_id: r.taken for r in mixing.mix(docs.dropDuplicates(["doc_id"]).drop("_keep")).collect()}
    assert sum(len((r.text or "").split()) for r in mixing.mixed_documents(docs.dropDuplicates(["doc_id"])).collect()) == sum(plan.values())
