import pytest
from tests.graphs import BRIDGE, DIAMOND, LOOPS, TAIL, graph

from graphloom.plans.compiler import UnsupportedQuery
from graphloom.plans.ir import Direction, Projection
from graphloom.plans.query import Empty, NotSingle, compiled


def ids(q):
    return sorted(r.id for r in q.to_list())


def test_description(spark):
    g = graph(spark, DIAMOND)
    e = g.relation("E")
    q = g.nodes("N").where(lambda n: n.id == 1).traverse(e).where(lambda n: n.name == "n2").take(9).take(4).skip(1).order_by("id")
    m = q.to_model()
    assert (m.result_alias, m.result_type, m.limit, m.offset) == ("node1", "N", 4, 1)
    assert m.predicate is not None and m.steps[0].predicate is not None
    assert list(m.parameters) == ["p0", "p1"]
    assert m.steps[0].direction is Direction.OUTGOING and m.steps[0].relation_alias == "relation1"
    assert m.orderings[0].alias == "node1"
    assert g.nodes("N").traverse_path(e).to_model().projection is Projection.PATH
    assert graph(spark, DIAMOND, directed=False).nodes("N").traverse(g.relation("E")).to_model().steps[0].direction is Direction.OUTGOING


@pytest.mark.parametrize(
    "f",
    [
        lambda q, e: q.take(0),
        lambda q, e: q.skip(-1),
        lambda q, e: q.then_by("id"),
        lambda q, e: q.traverse(e, -1, 2),
        lambda q, e: q.traverse(e, 3, 2),
        lambda q, e: q.traverse_any(),
        lambda q, e: q.traverse(e).shortest_path_to(q, e),
    ],
)
def test_bad_calls(spark, f):
    g = graph(spark, DIAMOND)
    with pytest.raises(ValueError):
        f(g.nodes("N"), g.relation("E"))


def test_paths_are_bags_and_distinct_is_not(spark):
    g = graph(spark, DIAMOND)
    two = g.nodes("N").where(lambda n: n.id == 1).traverse(g.relation("E"), 2, 2)
    assert ids(two) == [4, 4]
    assert ids(two.distinct()) == [4]
    assert two.count() == 2 and two.distinct().count() == 1


def test_loops_and_parallel_edges(spark):
    g = graph(spark, LOOPS)
    one = g.nodes("N").where(lambda n: n.id == 1).traverse(g.relation("E"))
    assert ids(one) == [1, 2, 2]
    assert ids(one.without_cycles()) == [2, 2]
    assert ids(graph(spark, LOOPS, directed=False).nodes("N").where(lambda n: n.id == 1).traverse(graph(spark, LOOPS, directed=False).relation("E"))) == [1, 2, 2]


def test_variable_depth(spark):
    g = graph(spark, TAIL)
    e = g.relation("E")
    start = g.nodes("N").where(lambda n: n.id == 1)
    assert ids(start.traverse(e, 0, 1)) == [1, 2]
    # No edge twice: the cycle closes once.
    assert ids(start.traverse(e, 1, 9)) == [1, 2, 3, 4]
    assert ids(start.traverse(e, 1, 9).without_cycles()) == [2, 3, 4]
    assert ids(start.traverse(e, 1, 9).distinct()) == [1, 2, 3, 4]
    assert ids(start.traverse(e, 3, 3).where(lambda n: n.id > 1)) == [4]


def test_undirected_two_steps_do_not_return(spark):
    g = graph(spark, [(1, 2), (2, 3)], directed=False)
    e = g.relation("E")
    assert ids(g.nodes("N").where(lambda n: n.id == 1).traverse(e).traverse(e)) == [3]
    assert ids(g.nodes("N").where(lambda n: n.id == 2).traverse(e)) == [1, 3]


def test_optional(spark):
    g = graph(spark, [(1, 2)], extra_nodes=[3])
    e = g.relation("E")
    q = g.nodes("N").traverse_optional(e).where(lambda n: n.id == 2)
    assert ids(q) == [2] and q.count() == 1
    assert ids(g.nodes("N").traverse_optional(e).traverse(e)) == []
    nodes, edges = g.nodes("N").traverse_optional(e).to_subgraph()
    assert sorted(r.id for r in nodes.collect()) == ["1", "2", "3"] and edges.count() == 1
    with pytest.raises(UnsupportedQuery):
        g.nodes("N").traverse_optional(e).without_cycles().to_df()


def test_terminals(spark):
    g = graph(spark, BRIDGE)
    q = g.nodes("N").order_by("id", descending=True)
    assert q.first().id == 6 and q.take(3).first().id == 6
    assert g.nodes("N").where(lambda n: n.id == 99).first_or_none() is None
    assert not g.nodes("N").where(lambda n: n.id == 99).any()
    with pytest.raises(Empty):
        g.nodes("N").where(lambda n: n.id == 99).single()
    with pytest.raises(NotSingle):
        q.single()
    assert q.skip(4).count() == 2
    assert [r.id for r in q.take(2).iterate()] == [6, 5]
    assert q.select("name").to_df().columns == ["name"]
    assert compiled(lambda x: g.nodes("N").where(lambda n: n.id == x))(2).count() == 1


def test_path_and_incoming(spark):
    g = graph(spark, [(1, 2, 5.0), (1, 3, 1.0)])
    e = g.relation("E")
    row = g.nodes("N").traverse_path(e).where_relation(lambda r: r.w > 2).single()
    assert (row.source.id, row.relation.w, row.target.id) == (1, 5.0, 2)
    assert [r.w for r in g.nodes("N").traverse_path(e).where_target(lambda n: n.id == 3).to_relations()] == [1.0]
    assert ids(g.nodes("N").where(lambda n: n.id == 3).traverse_incoming(e)) == [1]


def test_variable_depth_subgraph_returns_edges(spark):
    g = graph(spark, TAIL)
    nodes, edges = g.nodes("N").where(lambda n: n.id == 1).traverse(g.relation("E"), 1, 3).to_subgraph()
    assert sorted((r.source_id, r.target_id) for r in edges.collect()) == [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")]


def test_raw_sql(spark):
    g = graph(spark, TAIL)
    assert g.sql("SELECT count(*) AS n FROM E WHERE src = :s", s=3).first().n == 2
    with pytest.raises(ValueError):
        g.sql("  ")
