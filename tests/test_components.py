"""Connected components of pictures whose objects wind, speckle and cross many bands, against a flood fill."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from acutance.operators import geometry


def run_table(spark, masks):
    """The runs of masks (image_id to a boolean array), as C1 gives them."""
    parts = []
    for image, mask in masks.items():
        padded = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
        step = np.diff(padded, axis=1)
        y, x0 = np.nonzero(step == 1)
        x1 = np.nonzero(step == -1)[1] - 1
        parts.append(pa.table({"image_id": np.full(len(y), image, np.int32), "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32), "run": y.astype(np.int64) * (1 << 32) + x0}))
    return spark.createDataFrame(pa.concat_tables(parts).combine_chunks())


def united(mask, reach):
    """Places and labels of the runs by joining run after run with those above it: y, x0, least id of the object."""
    padded = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    ys, x0s = (a.tolist() for a in np.nonzero(step == 1))
    x1s = (np.nonzero(step == -1)[1] - 1).tolist()
    root = list(range(len(ys)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    j = 0
    for i in range(len(ys)):
        while ys[j] < ys[i] - 1 or (ys[j] == ys[i] - 1 and x1s[j] < x0s[i] - reach):
            j += 1
        o = j
        while ys[o] == ys[i] - 1 and x0s[o] <= x1s[i] + reach:
            a, b = top(i), top(o)
            root[max(a, b)] = min(a, b)
            o += 1
    ids = np.array(ys, np.int64) * (1 << 32) + np.array(x0s, np.int64)
    return ids, ids[[top(i) for i in range(len(ys))]] if len(ys) else ids


def spiral(n):
    """One line that winds inwards, with a gap of one pixel."""
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    free = lambda a, b: not (0 <= a < n and 0 <= b < n) or m[a, b]
    while True:
        if free(y + dy, x + dx) and not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]):
            dy, dx = dx, -dy
            if (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]) or not (0 <= y + dy < n and 0 <= x + dx < n):
                return m
        y, x = y + dy, x + dx
        m[y, x] = True


def check(spark, masks, reach=1, **sizes):
    found = geometry.connected_components(run_table(spark, masks), reach, **sizes).toPandas()
    for image, mask in masks.items():
        own = found[found.image_id == image].sort_values(["y", "x0"])
        ids, label = united(mask, reach)
        assert np.array_equal(own.run, ids) and np.array_equal(own.label, label)


@pytest.mark.parametrize("reach", [0, 1])
def test_shapes_across_bands(spark, reach):
    rng = np.random.default_rng(3)
    comb = np.zeros((90, 60), bool)
    comb[:, ::2] = True
    comb[-1] = True
    masks = {0: spiral(97), 1: rng.random((120, 80)) < 0.55, 2: rng.random((7, 300)) < 0.4, 3: comb, 4: np.zeros((5, 5), bool), 5: np.ones((130, 3), bool)}
    check(spark, masks, reach, band_rows=4, fan=3)
    check(spark, masks, reach)


def test_speckle_of_four_million_pixels(spark):
    rng = np.random.default_rng(7)
    check(spark, {0: rng.random((2000, 2000)) < 0.45, 1: spiral(1001)})


def test_steps_follow_the_height_alone(spark, monkeypatch):
    """Five bands with a fan of 8 take one step, whatever the object."""
    written = []
    monkeypatch.setattr(geometry, "materialise", lambda df, name, f=geometry.materialise: written.append(name) or f(df, name))
    geometry.connected_components(run_table(spark, {0: spiral(201)}), band_rows=41, fan=8).count()
    assert written.count("moved-labels") == 1
    written.clear()
    geometry.connected_components(run_table(spark, {0: spiral(201)})).count()
    assert written == ["run-labels"]
