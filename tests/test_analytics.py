import itertools
import math
import random

import numpy as np
import pytest
from tests.graphs import BRIDGE, DIAMOND, SQUARE, TAIL, as_dict, graph, projection

from graphloom.operators import centrality, clusters, community, paths, structure
from graphloom.operators.components import connected_components
from graphloom.operators.projection import Unsettled, project
from graphloom.plans.analytics import ALGORITHMS, Capabilities, Family, ProjectionDefinition, Projections, UnsupportedAnalytics


def test_all_algorithms_are_there():
    kinds = [a.family for a in Capabilities.all()]
    assert len(ALGORITHMS) == 33
    assert [kinds.count(f) for f in Family] == [11, 17, 5]


def test_two_triangles(spark):
    p = projection(spark, BRIDGE, directed=False)
    assert set(as_dict(community.triangle_count(p), "triangle_count").values()) == {1}
    lcc = as_dict(community.local_clustering(p), "local_clustering_coefficient")
    assert [round(lcc[i], 6) for i in range(1, 7)] == [1, 1, 0.333333, 0.333333, 1, 1]
    assert as_dict(community.kcore(p), "core_value") == dict.fromkeys(range(1, 7), 2)
    halves = spark.createDataFrame([(i, 1 if i < 4 else 2) for i in range(1, 7)], "id long, community int")
    assert sum(r.modularity for r in community.modularity(p, halves).collect()) == pytest.approx(5 / 14)
    assert {round(r.conductance, 6) for r in community.conductance(p, halves).collect()} == {round(1 / 7, 6)}


def test_bridge_and_articulation(spark):
    p = projection(spark, BRIDGE, directed=False)
    assert [(r["from"], r["to"], list(r.remaining_sizes)) for r in structure.bridges(p).collect()] == [(3, 4, [3, 3])]
    assert as_dict(structure.articulation_points(p), "resulting_components") == {3: 2, 4: 2}


def test_structure_against_brute_force(spark):
    draw = random.Random(5)
    edges = sorted({tuple(sorted(draw.sample(range(14), 2))) for _ in range(16)})

    def parts(nodes, kept):
        label = {n: n for n in nodes}
        for _ in nodes:
            for a, b in kept:
                label[a] = label[b] = min(label[a], label[b])
        return len(set(label.values()))

    nodes = sorted({x for e in edges for x in e})
    whole = parts(nodes, edges)
    bridges = {e for e in edges if parts(nodes, [x for x in edges if x != e]) > whole}
    cut = {}
    for n in nodes:
        k = parts([x for x in nodes if x != n], [e for e in edges if n not in e]) - whole + 1
        if k >= 2:
            cut[n] = k
    p = projection(spark, edges, directed=False)
    assert {(r["from"], r["to"]) for r in structure.bridges(p).collect()} == bridges
    assert as_dict(structure.articulation_points(p), "resulting_components") == cut


def test_components(spark):
    p = projection(spark, TAIL, extra_nodes=[9])
    assert as_dict(community.scc(p), "component_id") == {1: 1, 2: 1, 3: 1, 4: 4, 9: 9}
    assert as_dict(community.wcc(p), "component_id") == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(None, 3), (50, 50)], "src long, dst long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.filter("false")).count() == 0


def test_diamond(spark):
    p = projection(spark, DIAMOND)
    assert as_dict(centrality.betweenness(p), "score") == {1: 0, 2: 0.5, 3: 0.5, 4: 0}
    assert as_dict(centrality.degree(p), "score") == {1: 2, 2: 1, 3: 1, 4: 0}
    assert as_dict(centrality.closeness(p), "score") == {1: 0.75, 2: 1, 3: 1, 4: 0}
    assert as_dict(centrality.harmonic(p), "score") == pytest.approx({1: 2.5 / 3, 2: 1 / 3, 3: 1 / 3, 4: 0})
    g = graph(spark, DIAMOND)
    one, four = g.nodes("N").where(lambda n: n.id == 1), g.nodes("N").where(lambda n: n.id == 4)
    e = g.relation("E")
    row = one.shortest_path_to(four, e).single()
    assert (row.nodes, row.hop_count, row.total_cost) == ([1, 2, 4], 2, 2.0)
    assert sorted(r.nodes for r in one.shortest_path_to(four, e).all_shortest().to_list()) == [[1, 2, 4], [1, 3, 4]]
    assert one.shortest_path_to(four, e).max_depth(1).to_list() == []
    assert four.shortest_path_to(one, e).to_list() == []


def test_weighted_square(spark):
    g = graph(spark, SQUARE)
    one, four = g.nodes("N").where(lambda n: n.id == 1), g.nodes("N").where(lambda n: n.id == 4)
    r = one.shortest_path_to(four, g.relation("E")).weighted_by("w")
    assert (r.dijkstra().single().nodes, r.dijkstra().single().total_cost) == ([1, 2, 4], 2.0)
    assert [x.total_cost for x in sorted(r.yen(3).to_list(), key=lambda x: x["rank"])] == [2.0, 4.0, 5.0]
    with pytest.raises(UnsupportedAnalytics):
        one.shortest_path_to(four, g.relation("E")).dijkstra().to_df()
    p = projection(spark, SQUARE)
    assert as_dict(centrality.betweenness(p, weighted=True), "score") == {1: 0, 2: 1, 3: 0, 4: 0}


def test_negative_weights_are_refused(spark):
    p = projection(spark, [(1, 2, -1.0)])
    with pytest.raises(paths.NegativeWeight):
        paths.all_distances(p, weighted=True)


def test_pagerank_against_numpy(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 2), (4, 1)]
    a = np.zeros((4, 4))
    for s, d in edges:
        a[d - 1, s - 1] = 1
    a /= np.maximum(a.sum(axis=0), 1)
    x = np.full(4, 0.15)
    for _ in range(20):
        x = 0.15 + 0.85 * a @ x
    got = as_dict(centrality.pagerank(projection(spark, edges), tolerance=None), "score")
    assert [got[i] for i in range(1, 5)] == pytest.approx(list(x))
    # Without arcs nothing moves in the second round, and that ends it.
    assert set(as_dict(centrality.pagerank(projection(spark, [(1, 1)], extra_nodes=[2]), iterations=50, tolerance=0.2), "score")) == {1, 2}


def test_colours_differ(spark):
    edges = list(itertools.combinations(range(5), 2)) + [(5, 0), (6, 5)]
    color = as_dict(community.k1_coloring(projection(spark, edges, directed=False)), "color")
    assert all(color[a] != color[b] for a, b in edges) and len(set(color.values())) >= 5


def modularity_of(edges, label):
    m = len(edges)
    inside = sum(label[a] == label[b] for a, b in edges) / m
    volume = {}
    for a, b in edges:
        for x in (a, b):
            volume[label[x]] = volume.get(label[x], 0) + 1
    return inside - sum((v / (2 * m)) ** 2 for v in volume.values())


@pytest.mark.parametrize("run", [community.louvain, community.leiden])
def test_communities(spark, run):
    label = as_dict(run(projection(spark, BRIDGE, directed=False)), "community_id")
    assert modularity_of(BRIDGE, label) >= modularity_of(BRIDGE, {i: i for i in range(1, 7)}) + 0.3


def test_modularity_optimization_and_cut(spark):
    p = projection(spark, BRIDGE, directed=False)
    label = as_dict(community.modularity_optimization(p), "community_id")
    assert modularity_of(BRIDGE, label) > 0
    part = as_dict(community.max_k_cut(p), "community_id")
    assert set(part.values()) <= {0, 1} and sum(part[a] != part[b] for a, b in BRIDGE) >= 4


def test_labels(spark):
    p = projection(spark, BRIDGE, directed=False)
    assert set(as_dict(community.label_propagation(p, 10), "community_id")) == set(range(1, 7))
    spoken = as_dict(community.sllpa(p, 5), "values")
    assert all(v for v in spoken.values())


def test_celf_takes_the_hub(spark):
    p = projection(spark, [(1, i) for i in range(2, 9)])
    first = centrality.celf(p, seeds=1, probability=1.0, simulations=3).first()
    assert (first.id, first.spread) == (1, 8.0)


def test_vectors(spark):
    rows = [(i, [float(i % 2) * 10, 0.1 * (i % 5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    near = as_dict(clusters.kmeans(df, k=2), "community_id")
    assert len({near[i] for i in range(0, 30, 2)}) == 1 and near[0] != near[1]
    dense = as_dict(clusters.hdbscan(df, 3, 5), "cluster_id")
    assert len({dense[i] for i in range(0, 30, 2)}) == 1 and dense[0] != dense[1] and dense[0] >= 0


def test_refusals_before_anything_runs(spark):
    g = graph(spark, BRIDGE)
    a = g.nodes("N").analyze(g.relation("E"))
    with pytest.raises(UnsupportedAnalytics):
        a.using("dijkstra")
    with pytest.raises(UnsupportedAnalytics):
        a.using("nothing")
    with pytest.raises(UnsupportedAnalytics):
        a.wcc().weighted_by("w").to_df()
    with pytest.raises(UnsupportedAnalytics):
        a.conductance().to_df()
    with pytest.raises(UnsupportedAnalytics):
        a.pagerank().configure("louvain", levels=2)
    with pytest.raises(UnsupportedAnalytics):
        a.pagerank(colour=3)
    with pytest.raises(ValueError):
        a.pagerank(damping=1.5)
    with pytest.raises(ValueError):
        a.louvain(levels=0)
    with pytest.raises(ValueError):
        a.degree().top(0)
    assert dict(a.pagerank(damping=0.5).with_options(iterations=3).to_model().options) == {"damping": 0.5, "iterations": 3}
    assert dict(a.pagerank(damping=0.5).configure("pagerank", iterations=3).to_model().options) == {"iterations": 3}
    assert a.pagerank(damping=0.5).shape_key() == a.pagerank(damping=0.6).shape_key() != a.degree().shape_key()


def test_post_filter_and_top(spark):
    g = graph(spark, DIAMOND)
    found = g.nodes("N").where(lambda n: n.id > 1).analyze(g.relation("E")).degree().top(2).to_list()
    assert [(r.id, r.score) for r in found] == [(2, 1.0), (3, 1.0)]


def test_projections(spark):
    g = graph(spark, SQUARE)
    held = Projections(g)
    definition = ProjectionDefinition("p", "N", ("N", "E", "N"), directed=False, weight="w")
    first = held.ensure(definition)
    assert held.ensure(ProjectionDefinition("p", "N", ("N", "E", "N"), True)) is first
    assert [d.name for d in held.discover()] == ["p"]
    assert len(g.nodes("N").analyze(g.relation("E")).wcc().on_projection("p").to_list()) == 4
    held.drop("p")
    held.drop("p")
    with pytest.raises(UnsupportedAnalytics):
        g.nodes("N").analyze(g.relation("E")).wcc().on_projection("p").to_df()


def test_empty_graph(spark):
    p = projection(spark, [(1, 2)])
    none = type(p)(spark, p.nodes.filter("false"), p.arcs.filter("false"), True)
    for run in (community.wcc, community.scc, community.kcore, centrality.pagerank, structure.bridges, structure.articulation_points, community.k1_coloring, community.louvain):
        assert run(none).count() == 0


def test_haversine(spark):
    from pyspark.sql import functions as F

    far = spark.range(1).select(paths.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d")).first().d
    assert far == pytest.approx(math.pi / 2 * paths.EARTH_RADIUS)


def test_yen_has_no_hop_limit(spark):
    """A cheap chain of 20 hops is found beside a dear short route."""
    chain = [(i, i + 1, 1.0) for i in range(20)]
    p = projection(spark, [*chain, (0, 10, 50.0), (10, 20, 50.0)])
    ends = [spark.createDataFrame([(i,)], "id long") for i in (0, 20)]
    got = sorted(paths.yen(p, *ends, k=2).collect(), key=lambda r: r["rank"])
    assert [(r.hop_count, r.total_cost) for r in got] == [(20, 20.0), (11, 60.0)]


# --- keys of any type, and loops that finish or fail ---------------------------------------


def by_name(spark, edges, directed):
    """The same graph with keys like person-3."""
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(f"person-{i}",) for i in ids], "id string")
    rows = [(f"person-{e[0]}", f"person-{e[1]}", float(e[2]) if len(e) > 2 else 1.0) for e in edges]
    return project(nodes, spark.createDataFrame(rows, "src string, dst string, w double"), directed, "w")


def test_string_keys(spark):
    """Numbers below 10 sort as their names do, so results are the same up to the names."""
    plain, named = projection(spark, BRIDGE, directed=False), by_name(spark, BRIDGE, False)
    got = [(r["from"], r["to"], list(r.remaining_sizes)) for r in structure.bridges(named).collect()]
    assert got == [("person-3", "person-4", [3, 3])]
    assert as_dict(structure.articulation_points(named), "resulting_components") == {"person-3": 2, "person-4": 2}
    runs = [
        (community.wcc, "component_id"),
        (community.scc, "component_id"),
        (lambda p: community.louvain(p, intermediate=True), "community_id"),
        (community.leiden, "community_id"),
        (community.modularity_optimization, "community_id"),
        (community.label_propagation, "community_id"),
        (community.sllpa, None),
        (community.k1_coloring, None),
        (community.max_k_cut, None),
        (community.kcore, None),
        (community.triangle_count, None),
        (centrality.pagerank, None),
        (centrality.closeness, None),
        (centrality.betweenness, None),
        (centrality.hits, None),
        (centrality.celf, None),
        (community.clique_counting, None),
    ]
    names = {f"person-{i}" for i in range(1, 7)}
    for run, column in runs:
        b = run(named).collect()
        assert {r.id for r in b} <= names and b
        if column:
            assert {r[column] for r in b} <= names
        if run is community.wcc:
            assert {(f"person-{r.id}", f"person-{r.component_id}") for r in run(plain).collect()} == {(r.id, r.component_id) for r in b}
    levels = community.louvain(named, intermediate=True).collect()
    assert all(r.intermediate_community_ids and r.intermediate_community_ids[-1] == r.community_id for r in levels)
    ends = spark.createDataFrame([("person-1",)], "id string")
    route = paths.dijkstra(by_name(spark, SQUARE, True), ends, spark.createDataFrame([("person-4",), ("person-1",), (None,)], "id string")).collect()
    assert [(r.source, r.target, list(r.nodes), r.total_cost) for r in route] == [("person-1", "person-4", ["person-1", "person-2", "person-4"], 2.0)]


def test_components_refuse_what_is_no_number(spark):
    with pytest.raises(TypeError):
        connected_components(spark.createDataFrame([("a", "b")], "src string, dst string"))


def test_long_chain(spark):
    """A chain of 5,000 nodes is 5,000 components, found in few rounds."""
    n = 5000
    nodes = spark.range(n).selectExpr("id")
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "1.0D as w")
    got = community.scc(project(nodes, edges, True, "w"))
    assert got.count() == n and got.filter("id <> component_id").count() == 0


def test_chains_into_and_out_of_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 7), (8, 9), (10, 9), (11, 12), (12, 13), (14, 13)]
    got = as_dict(community.scc(projection(spark, edges)), "component_id")
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13, 14: 14}


def test_loops_fail_at_their_bound(spark, monkeypatch):
    ring = [(i, (i + 1) % 12) for i in range(12)]
    p = projection(spark, ring)
    monkeypatch.setattr(community, "MOST_ROUNDS", 3)
    with pytest.raises(Unsettled):
        community.scc(p)
    chain = projection(spark, [(i, i + 1) for i in range(14)], directed=False)
    with pytest.raises(Unsettled):
        community.kcore(chain)
    monkeypatch.setattr(community, "MOST_ROUNDS", 1)
    with pytest.raises(Unsettled):
        community.k1_coloring(chain)
    monkeypatch.setattr(paths, "MOST_ROUNDS", 3)
    ends = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(9,)], "id long")
    place = spark.createDataFrame([(i, 0.0, 0.0) for i in range(12)], "id long, lat double, lon double")
    for run in (lambda: paths.dijkstra(p, *ends), lambda: paths.a_star(p, *ends, place), lambda: paths.all_distances(p, weighted=True)):
        with pytest.raises(Unsettled):
            run()


def test_yen_goes_any_distance(spark):
    """The only path of a chain of 20 hops."""
    p = projection(spark, [(i, i + 1) for i in range(20)])
    got = paths.yen(p, spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(20,)], "id long"), 2).collect()
    assert [(r.hop_count, r.total_cost) for r in got] == [(20, 20.0)]


def test_many_targets_meet_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST_BROADCAST", 3)
    ids = spark.createDataFrame([(i,) for i in range(10)], "id long")
    got = {(r.source, r.target) for r in paths._pairs(ids, ids).collect()}
    assert got == {(a, b) for a in range(10) for b in range(10) if a != b}


def test_sources_in_batches(spark, monkeypatch):
    draw = random.Random(11)
    edges = [(draw.randrange(12), draw.randrange(12), float(draw.randint(1, 4))) for _ in range(30)]
    p = projection(spark, edges)
    runs = [centrality.closeness, centrality.harmonic, centrality.betweenness, lambda q: centrality.closeness(q, weighted=True)]
    whole = [as_dict(run(p), "score") for run in runs]
    monkeypatch.setattr(centrality, "SOURCES", 5)
    for run, want in zip(runs, whole, strict=True):
        assert as_dict(run(p), "score") == pytest.approx(want)
