import numpy as np
import pytest

from graphloom.llm import embed_dedup


def brute(rows, threshold):
    links = {i: set() for i, _ in rows}
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)]
    count = {i: 0 for i, _ in rows}
    for k, i, a in good:
        for m, j, b in good:
            if k != m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                count[i] += 1
                links[i].add(j)
    component = {}
    for i in sorted(links):
        if i not in component:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = i
                    todo += links[x]
    return count, component


@pytest.mark.parametrize(("block", "cells", "band"), [(1024, 1024, 32), (8, 16, 2)])
def test_against_brute_force(spark, monkeypatch, block, cells, band):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "MAX_CELLS", cells)
    monkeypatch.setattr(embed_dedup, "MOST_BAND", band)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 16))
    vectors = [base[draw.integers(12)] + draw.normal(size=16) * draw.choice([0.02, 0.3, 0.6]) for _ in range(90)]
    vectors += [vectors[3], vectors[3] * 2.5, vectors[3], -vectors[3], np.zeros(16)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(200, None), (201, [None] + [1.0] * 15), (202, [float("nan")] + [1.0] * 15), (203, [float("inf")] + [1.0] * 15), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [1e-200] * 16), (208, [1e200] * 16)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    count, component = brute([(i, v) for i, v in rows if i not in (207, 208)], 0.9)
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df).collect()}
    for i in count:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], component[i], component[i] == i), i
    assert (got[207].component_id, got[208].component_id) == (207, 207)


def test_hot_group_and_edges(spark):
    rows = [(i, [1.0, 0.5, 0.2]) for i in range(300)] + [(i, [-1.0, i / 1e5, 0.3]) for i in range(300, 400)] + [(None, [1.0, 0.5, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embed_dedup.embedding_duplicates(df)
    assert {(r.n_links, r.component_id) for r in got.filter("vec_id < 300").collect()} == {(299, 0)}
    assert {(r.n_links, r.component_id) for r in got.filter("vec_id >= 300").collect()} == {(99, 300)}
    assert [(r.n_links, r.component_id, r.kept) for r in got.filter("vec_id is null").collect()] == [(0, None, True)]
    assert embed_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_many_dimensions_and_single_precision(spark, monkeypatch):
    """Vectors of many lengths in one pass, in single precision and near the threshold."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    draw = np.random.default_rng(7)
    rows = []
    for dims, n in ((3, 60), (8, 40), (9, 130), (40, 120), (1, 4), (700, 3)):
        base = draw.normal(size=(4, dims))
        for _ in range(n):
            x = base[draw.integers(4)]
            y = draw.normal(size=dims) * np.linalg.norm(x) / np.sqrt(dims)
            rows.append((len(rows), [float(v) for v in (x + y * draw.choice([0.1, 0.33, 0.34, 0.48])).astype(np.float32)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    count, component = brute(rows, 0.9)
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df).collect()}
    for i in count:
        assert (got[i].n_links, got[i].component_id) == (count[i], component[i]), i
    assert embed_dedup.component_type(df, "embedding") is np.float32


def test_spanning_edges_join_what_the_links_join():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n, m = int(draw.integers(2, 12)), int(draw.integers(1, 30))
        i, j = draw.integers(0, n, m), draw.integers(0, n, m)
        label = np.arange(n)
        keep = embed_dedup._spanning(label, i, j)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert (label == want).all() and len(keep) == n - len(set(want.tolist()))
