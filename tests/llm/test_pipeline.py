"""The pipeline's stages in order, each on what its predecessor kept."""

from __future__ import annotations

import re

import corpus_pipeline
from acutance.session import materialise, read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns, name
        if name == "exact dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert out.count() == len({norm(r.text) for r in docs.collect()})
        if name != "mixing sources":
            assert out.count() <= before
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        docs, before = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and {"doc_id", "n_tokens", "ids_sha256"} <= set(last.columns)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
