"""Every registered query of the sharpness operators against DuckDB on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from acutance.plans import catalog
from acutance.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
#: Box sums are for dense pictures, code sets need four fiducials a picture and profile curves and shift maps six edges: the next larger tables have them.
LARGER = {"n1_box_sums", "n2_sauvola_mask", "n3_bradley_mask", "k7_match_code_set", "r13_profile_curve", "r26_ca_map"}
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def folder(name):
    return "/root/testdata/sf0.01" if name in LARGER else SF


@pytest.fixture(scope="module")
def duck():
    found = {}
    for d in {SF, folder("n1_box_sums")}:
        found[d] = duckdb.connect()
        for t in TABLES:
            found[d].sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return found


def flat(row):
    """The values of a row: texts and numbers, lists unfolded; NaN and None as texts."""
    for v in row:
        if isinstance(v, (list, tuple)):
            yield from flat(v)
        elif v is None or isinstance(v, (bool, str)):
            yield str(v)
        else:
            yield "nan" if math.isnan(v) else float(v)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, folder(name))
    columns = sorted(df.columns)
    rel = duck[folder(name)].sql(SQL[name])
    names = rel.columns
    assert sorted(names) == columns
    order = lambda row: [f"{v:.9f}" if isinstance(v, float) and v % 1 else str(v) for v in row]
    mine = sorted((list(flat(r[c] for c in columns)) for r in df.collect()), key=order)
    theirs = sorted((list(flat(r[names.index(c)] for c in columns)) for r in rel.fetchall()), key=order)
    assert len(mine) == len(theirs)
    assert not [(a, b) for a, b in zip(mine, theirs) if len(a) != len(b) or not all(map(close, a, b))][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, folder(name)).count() > 0
