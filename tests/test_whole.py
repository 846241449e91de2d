"""Queries over whole tables against their DuckDB counterparts."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom import workload, workload_sql

DATA = "/root/testdata/sf0.001"
WHOLE = ["p_in", "t_distinct", "x_any", "x_optional", "x_path", "x_simple_path", "x_subgraph_edges", "x_subgraph_nodes", "x_undirected", "x_undirected_2", "x_var_depth", "x_where_relation", "x_zero_depth"]
WHOLE += ["a_components_by_name", "r_shortest", "r_all_shortest", "r_dijkstra", "r_astar", "r_yen", "s_similar_pairs", "m_apply_plan", "m_delete_undirected"]
INVARIANTS = sorted(q for q in workload_sql.SQL if q.startswith("i_"))


def test_every_statement_has_a_query():
    assert set(workload_sql.SQL) <= set(workload.QUERIES)
    assert not [q for q in workload.QUERIES if q.endswith("_all")]


@pytest.mark.parametrize("name", [*WHOLE, *INVARIANTS])
def test_whole(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(workload_sql.SQL[name])
    columns = [c[0] for c in found.description]
    want = Counter(found.fetchall())
    got = Counter(tuple(r) for r in workload.QUERIES[name](spark, DATA).select(*(f"`{c}`" for c in columns)).collect())
    assert got == want and got
    assert not name.startswith("x_path") or len(got) == con.execute("SELECT count(*) FROM orders").fetchone()[0]


def parts_reached(edges, start, without):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for e in edges.get(at, ()):
            if e != without and (at, e) != without and (e, at) != without and e not in seen:
                seen.add(e)
                todo.append(e)
    return seen


def test_bridges_and_cut_nodes_of_the_whole_relation(spark):
    """By taking away each edge and node of BOUGHT_WITH."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    edges, pairs = {}, [(a, b) for a, b, _ in con.execute(workload_sql.BOUGHT).fetchall()]
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
        edges.setdefault(b, set()).add(a)
    bridges = {(min(p), max(p)) for p in pairs if p[1] not in parts_reached(edges, p[0], p)}
    cut = {n for n, own in edges.items() if len({frozenset(parts_reached(edges, x, n)) for x in own}) > 1}
    got = {(min(r["from"], r["to"]), max(r["from"], r["to"])) for r in workload.QUERIES["a_bridges"](spark, DATA).collect()}
    assert got == bridges
    assert {r.p_partkey for r in workload.QUERIES["a_articulation"](spark, DATA).collect()} == cut
