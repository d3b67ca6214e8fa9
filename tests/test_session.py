"""Shared folders and broadcasts."""

from __future__ import annotations

import time
from types import SimpleNamespace

import pytest

from acutance import session


def plain(master: str, **conf: str):
    settings = SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__)
    context = SimpleNamespace(master=master, getConf=lambda: settings, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=settings, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(plain(master))
    assert session.shared_dir(plain(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[4,2]"])
def test_one_process_may_use_its_own(master):
    assert session.shared_dir(plain(master)).startswith("file://")


def test_only_small_tables_are_broadcast(spark):
    names = lambda df: spark.range(5).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in names(session.broadcast_if_small(spark.range(10), 10))
    assert "strategy=broadcast" not in names(session.broadcast_if_small(spark.range(11), 10))


def test_candidates_beyond_the_bound_give_the_same_costs(spark, monkeypatch):
    from acutance.operators import lens

    ridge = spark.createDataFrame([(e, i, 0.1 * i, 0.02 * e + 0.01 * (i % 3) + 0.003 * i * i) for e in range(3) for i in range(9)], "edge_id int, seq int, x double, y double")
    grid = spark.createDataFrame([(c, 0.05 * c, 0.0) for c in range(4)], "cand int, k1 double, k2 double")
    cost = lambda: {r.cand: pytest.approx(r.cost) for r in lens.straightness(ridge, grid, ["edge_id"]).collect()}
    small = cost()
    monkeypatch.setattr(lens, "broadcast_if_small", lambda df: session.broadcast_if_small(df, 2))
    assert len(small) == 4 and cost() == small


def test_shuffle_files_go_when_a_query_ends(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in found.split() if "shuffle_" in x and x.endswith(".data")}

    before = files()
    with session.shuffles_dropped(spark):
        session.materialise(spark.range(1000).repartition(3, "id"), "dropped")
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    kept = session.materialise(spark.range(1000).repartition(3, "id"), "kept")
    assert kept.count() == 1000 and not files() <= before


def test_measurements_broadcast_only_what_is_counted(spark, monkeypatch):
    from acutance.operators import measure

    class Begun(Exception):
        pass

    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    px, seen = spark.createDataFrame([(0, 0, 0, 1)], "image_id int, y int, x int, v int"), []

    def begun(px):
        seen.append([spark.conf.get(n, None) for n in names])
        small = spark.range(3).join(spark.range(2), "id")
        assert "Broadcast" not in small._jdf.queryExecution().executedPlan().toString()
        raise Begun

    monkeypatch.setattr(measure, "whole_pixels", begun)
    had = [spark.conf.get(n, None) for n in names]
    for fn in (measure.measure_pictures, measure.measure_windows, lambda p: measure.measure_rois(p, p), lambda p: measure.measure_deferred(p, p)):
        with pytest.raises(Begun):
            fn(px)
    assert seen == [["-1", "-1"]] * 4 and [spark.conf.get(n, None) for n in names] == had


def test_pixels_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Each picture has one pixel, the mean of the same prices in another order; as sums of doubles the orders differ, and so does the pixel."""
    import itertools
    import math

    from pyspark.sql import functions as F

    from acutance.plans.registry import _steady_mean, view

    prices = [44385.08, 48406.87, 24347.21, 54020.84]  # the mean times 0.6 is 25674 exactly
    sums = {math.floor((((a + b) + c) + e) / 4 * 0.6) for a, b, c, e in itertools.permutations(prices)}
    assert sums == {25673, 25674}
    rows = [(15000 * i, 0, 0, v) for i, p in enumerate(itertools.permutations(prices)) for v in p]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = [r.v for r in view(spark, str(tmp_path), "v_pixels").collect()]
    assert len(found) == 24 and len(set(found)) == 1
    odd = spark.createDataFrame([(0, None), (1, math.nan), (1, 1.0), (2, 2e12), (2, 1e12), (3, -7.5), (3, None), (4, 0.1), (4, 0.2)], "k int, x double")
    means = {r.k: r.m for r in odd.groupBy("k").agg(F.expr(_steady_mean("x")).alias("m")).collect()}
    assert math.isnan(means.pop(1)) and means == {0: None, 2: 1.5e12, 3: -7.5, 4: pytest.approx(0.15, rel=1e-15)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_made_by_an_explode_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    from acutance.operators import charts, sampling, targets

    lines = spark.range(3).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("id", "k", "cast(k as double) cx", "1.0D cy", "0.5D angle")
    pts = spark.range(3).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).selectExpr("id", "cast(i as double) x", "cast(i % 7 as double) y", "0.5D theta", "1.0D gx", "0.3D gy", "1.0D w", "1 v")
    fits = spark.range(3).selectExpr("id", "10.0D t", "1.0D c", "0.1D b", "0.1D a1", "0.2D a2")
    for df in (targets.assign_to_edges(pts, lines, ["id"]), sampling.piecewise_fit(pts, ["id"]), sampling.sample_piecewise(pts, fits, ["id"]), charts.fit_ellipse(pts, ["id"])):
        assert "Broadcast" not in _plan(df)


def test_loess_zones_join_samples_before_they_are_spread_over_bins(spark):
    from acutance.operators import targets

    samples = spark.range(100).selectExpr("0 edge_id", "id / 10D - 5 perp", "cast(id as double) v")
    about = spark.createDataFrame([(0, 8.0, 20.0)], "edge_id int, half_width double, cnr double")
    lines = _plan(targets.esf_loess_zones(samples, about, ["edge_id"])).split("\n")
    spread = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("Join" in x for x in lines[spread:]) and not any("Join" in x for x in lines[:spread])
