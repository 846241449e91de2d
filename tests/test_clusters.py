"""Density clusters of more points than one task's tree takes."""

import numpy as np
import pytest

from graphloom.operators import clusters


def table(spark, points):
    return spark.createDataFrame([(i * 3 + 1, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vector array<double>")


@pytest.mark.parametrize(("n", "spread"), [(300, 0.2), (9, 1.0)])
def test_hdbscan_of_many_points(spark, monkeypatch, n, spread):
    draw = np.random.default_rng(n)
    points = np.concatenate([draw.normal(c, spread, size=(n // 3, 3)) for c in (0, 2, 5)])
    points[-1] = points[-2]  # equal points
    df = table(spark, points)
    want = {r.id: tuple(r)[1:] for r in clusters.hdbscan(df, 4, 5).collect()}
    monkeypatch.setattr(clusters, "MOST_POINTS", 8)
    got = {r.id: tuple(r)[1:] for r in clusters.hdbscan(df, 4, 5).collect()}
    assert got.keys() == want.keys() and len(want) == len(points)
    for i, row in want.items():
        assert got[i] == pytest.approx(row)


@pytest.mark.parametrize("known", [4, 16])
def test_tree_from_known_neighbours_weighs_the_same(known):
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(c, 0.1, size=(60, 4)) for c in (0, 1, 3)])
    n = len(points)
    near, far = clusters._nearest(points, np.arange(n), known, None, None)
    core, part, edges = far[:, 3].copy(), np.arange(n), []
    while True:
        more, part, need = clusters._grown(core, near, far, part)
        edges += more
        if not len(need):
            break
        near[need], far[need] = clusters._nearest(points, need, known, core, part)
    want = clusters._spanning_tree(points, core)
    assert len(edges) == n - 1
    assert sorted(w for _, _, w in edges) == pytest.approx(sorted(want[:, 2]))
