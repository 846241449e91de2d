"""Small graphs with results worked out by hand."""

from graphloom.model import ModelBuilder
from graphloom.operators.projection import project
from graphloom.sources.graph import Graph

BRIDGE = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
TAIL = [(1, 2), (2, 3), (3, 1), (3, 4)]
DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4)]
SQUARE = [(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.0), (3, 4, 3.0), (1, 4, 5.0)]
LOOPS = [(1, 1), (1, 2), (1, 2)]


def graph(spark, edges, directed=True, extra_nodes=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(extra_nodes))
    nodes = spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    rows = [(k, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for k, e in enumerate(edges)]
    table = spark.createDataFrame(rows, "edge_id long, src long, dst long, w double")
    model = ModelBuilder().node("N", nodes.columns).relation("E", "N", "N", table.columns, directed).build()
    return Graph(spark, model, {"N": nodes}, {("N", "E", "N"): table})


def projection(spark, edges, directed=True, extra_nodes=()):
    g = graph(spark, edges, directed, extra_nodes)
    return project(g.node_tables["N"].select("id"), g.edge_tables["N", "E", "N"], directed, "w")


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}
