"""All-sources measures in tasks, against plain Python."""

import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from tests.graphs import as_dict, projection

from graphloom.operators import centrality, kernels, paths


def chain(parts=4, size=12, arcs=30, seed=3):
    """Dense groups of nodes, each with an arc to the next one."""
    draw = random.Random(seed)
    out = set()
    for k in range(parts):
        own = range(k * size, (k + 1) * size)
        out |= {tuple(draw.sample(own, 2)) for _ in range(arcs)}
        if k:
            out.add((k * size - 1, k * size))
    return sorted(out)


def hops_from(edges):
    after = {}
    for a, b, *_ in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for s in {x for e in edges for x in e[:2]}:
        dist, todo = {s: 0}, deque([s])
        while todo:
            at = todo.popleft()
            for b in after.get(at, ()):
                if b not in dist:
                    dist[b] = dist[at] + 1
                    todo.append(b)
        out[s] = dist
    return out


def refuse(*_, **__):
    raise AssertionError("a row for each pair")


def test_closeness_makes_no_row_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(centrality, "all_distances", refuse)
    edges = chain()
    want = {s: (len(d) - 1) / sum(d.values()) if len(d) > 1 else 0.0 for s, d in hops_from(edges).items()}
    assert as_dict(centrality.closeness(projection(spark, edges, extra_nodes=[99])), "score") == pytest.approx(want | {99: 0.0})
    names = [(f"k{a:02}", f"k{b:02}") for a, b in edges]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in names for x in e})], "id string")
    from graphloom.operators.projection import project

    p = project(nodes, spark.createDataFrame(names, "src string, dst string"), directed=True)
    assert as_dict(centrality.closeness(p), "score") == pytest.approx({f"k{s:02}": v for s, v in want.items()})


def test_harmonic_makes_no_row_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(centrality, "all_distances", refuse)
    edges = chain(seed=8)
    far = hops_from(edges)
    want = {s: sum(1 / x for x in d.values() if x) / len(far) for s, d in far.items()}
    assert as_dict(centrality.harmonic(projection(spark, edges, extra_nodes=[99])), "score") == pytest.approx(want | {99: 0.0})


def test_betweenness_makes_no_row_for_a_pair(spark, monkeypatch):
    edges = chain(seed=4)
    p = projection(spark, edges, extra_nodes=[99])
    want = as_dict(centrality.betweenness(p, sources=p.nodes), "score")
    monkeypatch.setattr(centrality, "_dependencies", refuse)
    assert as_dict(centrality.betweenness(p), "score") == pytest.approx(want)
    assert max(want.values()) > 100


@pytest.mark.parametrize("most", [1, 7, 64, 65, 1000])
def test_hops_in_batches_of_any_size(most):
    edges = chain(parts=6, size=30, arcs=70)
    arcs = kernels.Arcs(*np.array(edges).T)
    found = {}

    def gather(level, nodes, counts):
        for v, c in zip(nodes, counts, strict=True):
            found[int(arcs.ids[v]), level] = found.get((int(arcs.ids[v]), level), 0) + int(c)

    for share in range(3):
        for some in kernels.batches(arcs.n, share, 3, most):
            kernels.reached(arcs, some, gather)
    want = {}
    for s, dist in hops_from(edges).items():
        for d in dist.values():
            if d:
                want[s, d] = want.get((s, d), 0) + 1
    assert found == want


@pytest.mark.parametrize("probability", [0.3, 1.0])
def test_celf_counts_what_joins_count_without_a_row_for_a_pair(spark, monkeypatch, probability):
    p = projection(spark, chain(parts=3, size=10), extra_nodes=[99])
    with monkeypatch.context() as m:
        m.setattr(kernels, "fits", lambda _: False)
        want = [tuple(r) for r in centrality.celf(p, seeds=4, probability=probability, simulations=5).collect()]
    monkeypatch.setattr(centrality, "_celf_by_joins", refuse)
    assert [tuple(r) for r in centrality.celf(p, seeds=4, probability=probability, simulations=5).collect()] == want


def ends(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def routed(df):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("depth", [None, 1, 3])
def test_shortest_routes_in_tasks(spark, monkeypatch, depth):
    p = projection(spark, chain(seed=5), extra_nodes=[99])
    a, b = ends(spark, 0, 5, 13, 99, 1000, None), ends(spark, *range(0, 48, 2), 99, 0)
    with monkeypatch.context() as m:
        m.setattr(kernels, "routable", lambda _: False)
        want = routed(paths.shortest_routes(p, a, b, depth))
    monkeypatch.setattr(paths, "written", refuse)
    got = paths.shortest_routes(p, a, b, depth).collect()
    assert routed(paths.shortest_routes(p, a, b, depth)) == want and len(got) == len(want) > 0


def weighted(edges, seed=9):
    draw = random.Random(seed)
    return [(a, b, draw.choice([0.0, 0.5, 1.0, 1.0, 2.0])) for a, b in edges]


def test_least_routes_in_tasks(spark, monkeypatch):
    p = projection(spark, weighted(chain(seed=6)), extra_nodes=[99])
    a, b = ends(spark, 0, 5, 13, 99, 1000, None), ends(spark, *range(0, 48, 2), 99, 0)
    with monkeypatch.context() as m:
        m.setattr(kernels, "routable", lambda _: False)
        want = routed(paths.dijkstra(p, a, b))
    monkeypatch.setattr(paths, "written", refuse)
    assert routed(paths.dijkstra(p, a, b)) == want and len(want) > 20
    costs = paths.dijkstra(p, a, b, nodes=False)
    assert "nodes" not in costs.columns
    assert routed(costs) == {(s, t, h, c) for s, t, _, h, c in want}


@pytest.mark.parametrize("targets", [range(0, 48, 2), [30, 99], [47]])
def test_a_star_in_tasks(spark, monkeypatch, targets):
    edges = [(a, b, 1.0 + (a * b) % 3) for a, b in chain(seed=7)]
    p = projection(spark, edges, extra_nodes=[99])
    # Neighbours lie within a degree or so of each other in value; node 7 has no place.
    places = spark.createDataFrame([(i, None if i == 7 else i / 50, i / 40) for i in range(48)], "id long, lat double, lon double")
    a, b = ends(spark, 0, 5, 13, 99), ends(spark, *targets)
    want = routed(paths.dijkstra(p, a, b))
    with monkeypatch.context() as m:
        m.setattr(kernels, "routable", lambda _: False)
        assert routed(paths.a_star(p, a, b, places, scale=0.005)) == want
    monkeypatch.setattr(paths, "written", refuse)
    assert routed(paths.a_star(p, a, b, places, scale=0.005)) == want and want


def test_a_star_leaves_out_what_lies_too_far():
    """A dead end far away is not searched when the one target is near."""
    g = object.__new__(kernels._Share)
    g.ids, g.n = np.arange(6), 6  # 0 -> 1 is the target; 0 -> 2 -> 3 -> 4 -> 5 leads away
    g.heads, g.w, g.at = np.array([1, 2, 3, 4, 5]), np.ones(5), np.array([0, 2, 2, 3, 4, 5, 5])
    g.wanted = np.arange(6) == 1
    g.places = np.array([[0, 0], [0, 0.01], [0, -0.01], [0, -20], [0, -40], [0, -60.0]])
    cost, _ = kernels._least(g, 0, kernels._towards_targets(g, 0.01))
    assert cost[1] == 1 and np.isinf(cost[4]) and np.isinf(cost[5])
    assert np.isfinite(kernels._least(g, 0, None)[0]).all()


@pytest.mark.parametrize(("k", "most"), [(1, 48), (3, 48), (4, 5)])
def test_first_paths_in_tasks(spark, monkeypatch, k, most):
    edges = weighted(chain(parts=3, size=7, arcs=14, seed=12))
    p = projection(spark, [e for e in edges if e[2]], extra_nodes=[99])
    a, b = ends(spark, 0, 5, 9, 99, None), ends(spark, *range(21), 99)
    with monkeypatch.context() as m:
        m.setattr(kernels, "routable", lambda _: False)
        want = routed(paths.yen(p, a, b, k))
    monkeypatch.setattr(paths, "written", refuse)
    monkeypatch.setattr(kernels, "MOST_WALKS", most)
    found = paths.yen(p, a, b, k)
    assert found.columns == ["source", "target", "rank", "nodes", "hop_count", "total_cost"]
    got = found.collect()
    assert routed(found) == want and len(got) == len(want) > 10


def test_walks_beyond_the_most_are_searched_pair_by_pair():
    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (0, 2, 9.0), (2, 3, 1.0), (1, 3, 50.0)]
    g = object.__new__(kernels._Share)
    g.ids, g.n = np.arange(4), 4
    edges = sorted(edges)
    g.heads, g.w = np.array([e[1] for e in edges]), np.array([e[2] for e in edges])
    g.at = np.concatenate([[0], np.cumsum(np.bincount([e[0] for e in edges], minlength=4))])
    g.wanted = np.ones(4, dtype=bool)
    got = {}
    for end, rank, hop, cost, path in kernels._first_paths(g, 0, 3):
        for row in zip(end, rank, hop, cost, path, strict=True):
            got[int(row[0]), int(row[1])] = (int(row[2]), float(row[3]), [int(x) for x in row[4]])
    assert got == {
        (1, 1): (1, 1.0, [0, 1]), (1, 2): (2, 10.0, [0, 2, 1]),
        (2, 1): (2, 2.0, [0, 1, 2]), (2, 2): (1, 9.0, [0, 2]),
        (3, 1): (3, 3.0, [0, 1, 2, 3]), (3, 2): (2, 10.0, [0, 2, 3]), (3, 3): (2, 51.0, [0, 1, 3]),
    }


def blocks(seed, parts=5, size=9, arcs=30):
    """Dense parts; each shares a node with an earlier one, or an arc leads to it or from it."""
    draw = random.Random(seed)
    out, nodes = set(), [0]
    for _ in range(parts):
        fresh = list(range(max(nodes) + 1, max(nodes) + 1 + draw.choice([1, 2, size])))
        joint = draw.choice(nodes)
        if draw.random() < 0.5:
            own = [*fresh, joint]
        else:
            own, end = fresh, draw.choice(fresh)
            out.add(draw.choice([(joint, end), (end, joint)]))
        out |= {tuple(draw.sample(own, 2)) for _ in range(arcs if len(own) > 1 else 0)}
        nodes += fresh
    return sorted(out)


def between(edges):
    """Shares of shortest paths through each node, from counts of paths."""
    far = hops_from(edges)
    before = {}
    for a, b in set(edges):
        before.setdefault(b, []).append(a)
    count = {}
    for s, dist in far.items():
        count[s, s] = 1
        for v in sorted(dist, key=dist.get)[1:]:
            count[s, v] = sum(count[s, u] for u in before[v] if dist.get(u) == dist[v] - 1)
    out = dict.fromkeys(far, 0.0)
    for s, dist in far.items():
        for v in dist:
            out[v] += sum(count[s, v] * count[v, t] / count[s, t] for t, d in far[v].items() if s != v != t and dist[v] + d == dist[t])
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_searches_each_block_by_itself(spark, monkeypatch, directed):
    edges = [(a + 500 * k, b + 500 * k) for k in range(4) for a, b in blocks(k)]
    want = between(edges if directed else edges + [(b, a) for a, b in edges])
    monkeypatch.setattr(centrality, "_dependencies", refuse)
    p = projection(spark, edges, directed, extra_nodes=[9999])
    half = 1.0 if directed else 0.5
    assert as_dict(centrality.betweenness(p), "score") == pytest.approx({v: x * half for v, x in want.items()} | {9999: 0.0})
    assert max(want.values()) > 20


@pytest.mark.parametrize("together", [3, 4096])
def test_betweenness_of_blocks_costs_no_more_than_each(monkeypatch, together):
    """Twenty groups in a row: sources of one are not followed through the others."""
    edges = np.array(chain(parts=20, size=30, arcs=120, seed=2))
    moved = []
    monkeypatch.setattr(kernels, "TOGETHER", together)
    monkeypatch.setattr(kernels, "_sums", lambda x, rows, begin, f=kernels._sums: moved.append(len(rows) * x.shape[1]) or f(x, rows, begin))
    dealt = kernels._blocked(pa.table({"src": edges[:, 0], "dst": edges[:, 1]}))
    rows = dealt.to_pylist()
    assert max(r["pairs"] for r in rows) >= 2 * 2 * 19
    for share in range(kernels.SHARES):
        own = [r | {"part": k, "ins": None, "outs": None} for r in rows for k in range(r["many"]) if (r["first"] + k) % kernels.SHARES == share]
        if own:
            schema = pa.schema([(c, pa.int64()) for c in ("src", "dst", "block", "many", "part")] + [("ins", pa.float64()), ("outs", pa.float64())])
            kernels._within(pa.Table.from_pylist([{c: r[c] for c in schema.names} for r in own], schema))
    # Once ahead and once back for each level, of which nodes of a batch see several.
    assert 0 < sum(moved) < 20 * (30 * 121) * 2 * 10


def test_betweenness_beyond_the_paths_a_number_counts(spark):
    """1,100 diamonds in a row: 2^1100 shortest paths from end to end."""
    k = 1100
    edges = [e for i in range(0, 3 * k, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    n = 3 * k + 1
    want = {i: i * (n - 1 - i) if i % 3 == 0 else (i // 3 * 3 + 1) * (n - 3 - i // 3 * 3) / 2 for i in range(n)}
    assert as_dict(centrality.betweenness(projection(spark, edges)), "score") == pytest.approx(want)


def test_too_many_paths_within_a_block_fail():
    """Pairs of nodes, each with arcs to both of the next pair: no node parts them, and paths double from pair to pair."""
    k = 1200
    edges = [(2 * i + x, 2 * i + 2 + y) for i in range(k) for x in (0, 1) for y in (0, 1)]
    arcs = kernels.Arcs(*np.array(edges).T)
    one = np.ones(arcs.n)
    with pytest.raises(FloatingPointError):
        kernels._brandes(arcs, np.array([0]), np.array([0]), np.zeros(arcs.n, dtype=np.int64), one, one, np.zeros(arcs.n))


def test_sums_of_many_and_of_few():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 9, (50, 3)).astype(float)
    for sizes in ([3000, 1, 2], draw.integers(1, 30, 40), [1], [1] * 20):
        rows, begin = draw.integers(0, 50, sum(sizes)), np.cumsum(sizes) - sizes
        assert (kernels._sums(x, rows, begin) == np.add.reduceat(x[rows], begin, axis=0)).all()
