"""The same results in DuckDB SQL, written independently of the engine.

Iterative algorithms are unrolled to a fixed number of rounds or use recursive
common table expressions.
"""

from __future__ import annotations

FOLLOWED = """SELECT a.user_id AS src, b.user_id AS dst, count(*) AS weight FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE b.event_type = 'error' AND a.user_id <> b.user_id GROUP BY 1, 2"""


BOUGHT = """SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_quantity >= 45 AND b.l_quantity >= 45 GROUP BY 1, 2"""
RETURNED = """SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R' AND l_quantity >= 49"""
USERS = "SELECT DISTINCT user_id AS id FROM events"
PARTS = "SELECT p_partkey AS id FROM part"


def _both(edges: str) -> str:
    return f"SELECT src, dst, weight FROM ({edges}) UNION ALL SELECT dst, src, weight FROM ({edges})"


def _with(nodes: str, edges: str, *ctes: str, recursive: bool = False) -> str:
    own = [f"n AS MATERIALIZED ({nodes})", f"e AS MATERIALIZED ({edges})", *ctes]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(own)


SQL: dict[str, str] = {}

# --- filters ------------------------------------------------------------------------

SQL["q_filter_take"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50"
SQL["q_traverse_out"] = """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""
SQL["p_compare"] = "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 5000 AND c_nationkey <> 3 AND c_custkey >= 10"
SQL["p_null"] = "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000"
SQL["p_not_null"] = "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 500"
SQL["p_logical_not"] = "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'BUILDING')"
SQL["p_null_logic"] = "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer) WHERE NOT (b > 2000) OR b <> 7.5"
SQL["p_bool"] = "SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer WHERE c_acctbal > 5000 AND NOT c_nationkey < 20"
SQL["p_string"] = """SELECT p_partkey, p_type, p_brand FROM part
WHERE starts_with(p_type, 'PROMO') OR contains(p_name, '1%') OR ends_with(p_brand, '3')"""
SQL["p_in"] = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
SQL["p_not_in"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"

# --- shape --------------------------------------------------------------------------

SQL["t_order_then"] = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40"
SQL["t_order_nulls"] = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer
ORDER BY balance DESC NULLS FIRST, c_custkey LIMIT 200"""
SQL["t_skip_take"] = "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 30"
SQL["t_distinct"] = """SELECT DISTINCT p_partkey, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""
SQL["t_count"] = "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000"
SQL["t_count_distinct"] = """SELECT count(DISTINCT l_partkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 200000"""
SQL["t_count_page"] = "SELECT count(*) AS n FROM (SELECT * FROM region LIMIT 10 OFFSET 2)"
SQL["t_any"] = "SELECT max(c_acctbal) > 9990 AS some, false AS none FROM customer"
SQL["t_first"] = "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1"
SQL["t_single"] = "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7"
SQL["t_select"] = "SELECT s_name FROM supplier"

# --- traversals ---------------------------------------------------------------------

SQL["x_incoming"] = "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2) AND c_acctbal > 0"
SQL["x_undirected"] = f"WITH e AS ({_both(BOUGHT)}) SELECT p_partkey, p_size FROM e JOIN part ON p_partkey = dst"
SQL["x_undirected_2"] = f"""WITH e AS ({_both(BOUGHT)})
SELECT b.dst AS p_partkey FROM e a JOIN e b ON b.src = a.dst WHERE b.dst <> a.src"""
SQL["x_chain3"] = """SELECT p_partkey, p_size FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 250000 AND p_size < 10"""
SQL["x_optional"] = f"SELECT s_suppkey, s_acctbal FROM ({RETURNED}) JOIN supplier ON s_suppkey = dst WHERE s_acctbal > 0"
SQL["x_optional_count"] = f"SELECT count(*) AS n FROM ({RETURNED})"
SQL["x_optional_required"] = f"SELECT n_nationkey, n_name FROM ({RETURNED}) JOIN supplier ON s_suppkey = dst JOIN nation ON n_nationkey = s_nationkey"
SQL["x_any"] = """SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"""
SQL["x_path"] = "SELECT o_custkey AS c_custkey, o_totalprice AS price, o_orderkey FROM orders"
SQL["x_where_relation"] = """SELECT l_orderkey AS o_orderkey, l_quantity AS quantity, l_partkey AS p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_quantity >= 45 AND p_size > 25"""
_THREE = f"""WITH e AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS i FROM ({FOLLOWED})),
d1 AS (SELECT src AS s, dst, i AS a FROM e),
d2 AS (SELECT s, d1.dst AS m, e.dst, a, i AS b FROM d1 JOIN e ON e.src = d1.dst WHERE i <> a),
d3 AS (SELECT s, m, d2.dst AS o, e.dst, a, b, i AS c FROM d2 JOIN e ON e.src = d2.dst WHERE i <> a AND i <> b)"""
SQL["x_var_depth"] = f"{_THREE} SELECT dst AS user_id FROM d1 UNION ALL SELECT dst FROM d2 UNION ALL SELECT dst FROM d3"
SQL["x_var_depth_distinct"] = f"""WITH RECURSIVE e AS MATERIALIZED ({FOLLOWED}),
r(id, d) AS (SELECT DISTINCT user_id, 0 FROM events UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id WHERE d < 4)
SELECT DISTINCT id AS user_id FROM r WHERE d > 0"""
SQL["x_zero_depth"] = f"SELECT id AS user_id FROM ({USERS}) UNION ALL SELECT dst FROM ({FOLLOWED})"
SQL["x_simple_path"] = f"""{_THREE} SELECT dst AS user_id FROM d2 WHERE dst <> s
UNION ALL SELECT dst FROM d3 WHERE o <> s AND dst <> s AND dst <> m"""
_SUB = "orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
SQL["x_subgraph_nodes"] = f"""SELECT DISTINCT 'Customer' AS label, CAST(o_custkey AS VARCHAR) AS id FROM {_SUB}
UNION ALL SELECT DISTINCT 'Order', CAST(o_orderkey AS VARCHAR) FROM {_SUB} UNION ALL SELECT DISTINCT 'Part', CAST(p_partkey AS VARCHAR) FROM {_SUB}"""
SQL["x_subgraph_edges"] = f"""SELECT DISTINCT 'PLACED' AS relation, CAST(o_custkey AS VARCHAR) AS source_id, CAST(o_orderkey AS VARCHAR) AS target_id,
round(o_totalprice, 2) AS price, NULL::DOUBLE AS quantity FROM {_SUB}
UNION ALL SELECT 'CONTAINS', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), NULL, l_quantity FROM {_SUB}"""
SQL["x_raw_sql"] = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment"

# --- analytics ----------------------------------------------------------------------

SQL["a_degree"] = _with(USERS, FOLLOWED) + " SELECT id AS user_id, round(CAST(coalesce(sum(weight), 0) AS DOUBLE), 6) AS score FROM n LEFT JOIN e ON src = id GROUP BY id"


def _ranks(shares: str, rounds: int) -> list[str]:
    out = [f"f AS MATERIALIZED ({shares})", "s0 AS (SELECT id, 0.15 AS s FROM n)"]
    for i in range(1, rounds + 1):
        out.append(
            f"g{i} AS MATERIALIZED (SELECT dst, sum(s * share) AS got FROM f JOIN s{i - 1} ON id = src GROUP BY dst), "
            f"s{i} AS MATERIALIZED (SELECT id, 0.15 + 0.85 * coalesce(got, 0) AS s FROM n LEFT JOIN g{i} ON dst = id)"
        )
    return out


_SHARE = "SELECT e.src, dst, 1.0 / o AS share FROM e JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) x ON x.src = e.src"
SQL["a_pagerank"] = _with(USERS, FOLLOWED, *_ranks(_SHARE, 20)) + " SELECT id AS user_id, round(s, 6) AS score FROM s20"
_WSHARE = "SELECT e.src, dst, CAST(weight AS DOUBLE) / o AS share FROM e JOIN (SELECT src, sum(weight) AS o FROM e GROUP BY src) x ON x.src = e.src"
SQL["a_pagerank_top"] = _with(USERS, FOLLOWED, *_ranks(_WSHARE, 10)) + " SELECT id AS user_id, round(s, 6) AS score FROM s10 WHERE id % 180 - 90 > -70 ORDER BY s DESC, id LIMIT 10"
_ASHARE = """SELECT e.src, dst, 1.0 / (o + (SELECT count(*) FROM e) / CAST((SELECT count(*) FROM n) AS DOUBLE)) AS share
FROM e JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) x ON x.src = e.src"""
SQL["a_articlerank"] = _with(USERS, FOLLOWED, *_ranks(_ASHARE, 20)) + " SELECT id AS user_id, round(s, 6) AS score FROM s20"


def _eigen(rounds: int) -> list[str]:
    out = ["s0 AS MATERIALIZED (SELECT id, 1.0 / sqrt((SELECT count(*) FROM n)) AS s FROM n)"]
    for i in range(1, rounds + 1):
        out.append(
            f"g{i} AS MATERIALIZED (SELECT id, sum(s) AS s FROM (SELECT dst AS id, s FROM e JOIN s{i - 1} ON id = src UNION ALL SELECT id, s FROM s{i - 1}) GROUP BY id), "
            f"s{i} AS MATERIALIZED (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM g{i}) AS s FROM g{i})"
        )
    return out


SQL["a_eigenvector"] = _with(USERS, FOLLOWED, *_eigen(10)) + " SELECT id AS user_id, round(s, 6) AS score FROM s10"


def _hits(rounds: int) -> list[str]:
    out = ["h0 AS MATERIALIZED (SELECT id, 1.0 AS h FROM n)"]
    for i in range(1, rounds + 1):
        out.append(
            f"x{i} AS MATERIALIZED (SELECT n.id, coalesce(sum(h), 0) AS a FROM n LEFT JOIN e ON dst = n.id LEFT JOIN h{i - 1} p ON p.id = src GROUP BY n.id), "
            f"a{i} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS a FROM x{i}), "
            f"y{i} AS MATERIALIZED (SELECT n.id, coalesce(sum(a), 0) AS h FROM n LEFT JOIN e ON src = n.id LEFT JOIN a{i} p ON p.id = dst GROUP BY n.id), "
            f"h{i} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{i}) AS h FROM y{i})"
        )
    return out


SQL["a_hits"] = _with(USERS, FOLLOWED, *_hits(6)) + " SELECT a6.id AS user_id, round(a, 6) AS auth, round(h, 6) AS hub FROM a6 JOIN h6 ON h6.id = a6.id"

_FAR = "r(s, id, d) AS (SELECT id, id, 0 FROM n UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id WHERE r.d < 12), far AS MATERIALIZED (SELECT s, id, min(d) AS d FROM r GROUP BY s, id)"
SQL["a_closeness"] = _with(USERS, FOLLOWED, _FAR, recursive=True) + """ SELECT n.id AS user_id, round(coalesce(count(far.id) / CAST(sum(d) AS DOUBLE), 0), 6) AS score
FROM n LEFT JOIN far ON far.s = n.id AND d > 0 GROUP BY n.id"""
SQL["a_harmonic"] = _with(USERS, FOLLOWED, _FAR, recursive=True) + """ SELECT n.id AS user_id, round(coalesce(sum(1.0 / d), 0) / ((SELECT count(*) FROM n) - 1), 6) AS score
FROM n LEFT JOIN far ON far.s = n.id AND d > 0 GROUP BY n.id"""


def _paths_by_level(levels: int) -> list[str]:
    out = ["p0 AS MATERIALIZED (SELECT s, id, 1.0 AS c FROM far WHERE d = 0)"]
    for i in range(1, levels + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT p.s, f.id, sum(c) AS c FROM p{i - 1} p JOIN e ON e.src = p.id JOIN far f ON f.s = p.s AND f.id = e.dst AND f.d = {i} GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(levels + 1))
    return [*out, f"c AS MATERIALIZED ({union})", "k AS MATERIALIZED (SELECT far.s, far.id, d, c FROM far JOIN c ON c.s = far.s AND c.id = far.id)"]


SQL["a_betweenness"] = _with(USERS, FOLLOWED, _FAR, *_paths_by_level(12), recursive=True) + """,
b AS (SELECT x.id, sum(x.c * y.c / z.c) AS score FROM k x JOIN k y ON y.s = x.id JOIN k z ON z.s = x.s AND z.id = y.id
      WHERE x.d > 0 AND y.d > 0 AND x.d + y.d = z.d GROUP BY x.id)
SELECT n.id AS user_id, round(coalesce(score, 0), 6) AS score FROM n LEFT JOIN b ON b.id = n.id"""

SQL["a_wcc"] = _with(PARTS, _both(BOUGHT), "r(id, c) AS (SELECT id, id FROM n UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id WHERE r.c < e.dst)", recursive=True) + " SELECT id AS p_partkey, min(c) AS component_id FROM r GROUP BY id"
SQL["a_scc"] = _with(USERS, FOLLOWED, "r(s, id) AS (SELECT id, id FROM n UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.id)", recursive=True) + """
SELECT a.s AS user_id, min(a.id) AS component_id FROM r a JOIN r b ON b.s = a.id AND b.id = a.s GROUP BY a.s"""
_TRI = "t AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst), k AS MATERIALIZED (SELECT id, count(*) AS n FROM (SELECT unnest([x, y, z]) AS id FROM t) GROUP BY id)"
SQL["a_triangles"] = _with(PARTS, BOUGHT, _TRI) + " SELECT n.id AS p_partkey, coalesce(k.n, 0) AS triangle_count FROM n LEFT JOIN k ON k.id = n.id"
SQL["a_lcc"] = _with(PARTS, BOUGHT, _TRI, f"d AS (SELECT src AS id, count(*) AS d FROM ({_both(BOUGHT)}) GROUP BY src)") + """
SELECT n.id AS p_partkey, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(k.n, 0) / (d * (d - 1)) ELSE 0 END, 6) AS local_clustering_coefficient
FROM n LEFT JOIN k ON k.id = n.id LEFT JOIN d ON d.id = n.id"""
SQL["a_cliques"] = _with(USERS, f"SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({FOLLOWED})",
    "t AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst)",
    "q AS MATERIALIZED (SELECT x, y, z, a.dst AS w FROM t JOIN e a ON a.src = z JOIN e b ON b.src = y AND b.dst = a.dst JOIN e c ON c.src = x AND c.dst = a.dst)",
    "m AS (SELECT unnest([x, y, z]) AS id, 3 AS k FROM t UNION ALL SELECT unnest([x, y, z, w]), 4 FROM q)") + """
SELECT n.id AS user_id, count(k) AS clique_count, coalesce(max(k), CASE WHEN n.id IN (SELECT src FROM e UNION SELECT dst FROM e) THEN 2 ELSE 1 END) AS max_clique_size
FROM n LEFT JOIN m ON m.id = n.id GROUP BY n.id"""


def _cores(rounds: int) -> list[str]:
    out = ["c0 AS MATERIALIZED (SELECT n.id, count(src) AS c FROM n LEFT JOIN e ON src = n.id GROUP BY n.id)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""c{i} AS MATERIALIZED (SELECT p.id, least(p.c, coalesce(h, 0)) AS c FROM c{i - 1} p LEFT JOIN (
SELECT id, max(least(v, above)) AS h FROM (SELECT id, v, sum(k) OVER (PARTITION BY id ORDER BY v DESC) AS above
FROM (SELECT src AS id, c AS v, count(*) AS k FROM e JOIN c{i - 1} q ON q.id = dst GROUP BY 1, 2)) GROUP BY id) x ON x.id = p.id)"""
        )
    return out


SQL["a_kcore"] = _with(PARTS, _both(BOUGHT), *_cores(25)) + " SELECT id AS p_partkey, CAST(c AS BIGINT) AS core_value FROM c25"


def _labels(rounds: int) -> list[str]:
    out = ["l0 AS MATERIALIZED (SELECT id, id AS l FROM n)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""l{i} AS MATERIALIZED (SELECT p.id, coalesce(v, p.l) AS l FROM l{i - 1} p LEFT JOIN (
SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY w DESC, v) AS k
FROM (SELECT src AS id, l AS v, sum(weight) AS w FROM e JOIN l{i - 1} q ON q.id = dst GROUP BY 1, 2)) WHERE k = 1) x ON x.id = p.id)"""
        )
    return out


SQL["a_lpa"] = _with(PARTS, _both(BOUGHT), *_labels(5)) + " SELECT id AS p_partkey, l AS community_id FROM l5"
_SHELF = "s AS (SELECT p_partkey AS id, p_size % 5 AS c FROM part), x AS MATERIALIZED (SELECT a.c AS cs, b.c AS cd, weight AS w FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst)"
SQL["a_modularity"] = _with(PARTS, _both(BOUGHT), _SHELF) + """ SELECT cs AS community_id,
round(CAST(coalesce(sum(w) FILTER (WHERE cs = cd), 0) AS DOUBLE) / (SELECT sum(w) FROM x) - pow(CAST(sum(w) AS DOUBLE) / (SELECT sum(w) FROM x), 2), 6) AS modularity FROM x GROUP BY cs"""
SQL["a_conductance"] = _with(PARTS, _both(BOUGHT), _SHELF) + """ SELECT cs AS community_id,
round(CAST(coalesce(sum(w) FILTER (WHERE cs <> cd), 0) AS DOUBLE) / sum(w), 6) AS conductance FROM x GROUP BY cs"""
SQL["a_articulation"] = _with(PARTS, _both(BOUGHT), "g AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)",
    "r(gone, a, b) AS (SELECT src, dst, dst FROM e UNION SELECT r.gone, r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE e.dst <> r.gone)", recursive=True) + """,
p AS (SELECT gone, a, min(b) AS part FROM r GROUP BY gone, a)
SELECT gone AS p_partkey, count(DISTINCT part) AS resulting_components FROM p GROUP BY gone HAVING count(DISTINCT part) >= 2"""
SQL["a_bridges"] = _with(PARTS, _both(BOUGHT), f"u AS MATERIALIZED ({BOUGHT})",
    "r(x, y, a, b) AS (SELECT src, dst, src, src FROM u UNION SELECT src, dst, dst, dst FROM u UNION SELECT r.x, r.y, r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE NOT (e.src = r.x AND e.dst = r.y) AND NOT (e.src = r.y AND e.dst = r.x))",
    recursive=True) + """,
k AS (SELECT x, y, count(*) FILTER (WHERE a = x) AS sx, count(*) FILTER (WHERE a = y) AS sy, bool_or(a = x AND b = y) AS joined FROM r GROUP BY x, y)
SELECT x AS "from", y AS "to", sx AS size_from, sy AS size_to FROM k WHERE NOT joined"""

# --- routes -------------------------------------------------------------------------

#: Every fiftieth user is asked for routes to all others.
_FROM = "% 50 = 0"
_WALK = f"""w(s, t, p, h, c) AS (SELECT src, dst, [src, dst], 1, CAST(weight AS DOUBLE) FROM e WHERE src {_FROM}
UNION ALL SELECT w.s, e.dst, list_append(w.p, e.dst), w.h + 1, w.c + e.weight FROM w JOIN e ON e.src = w.t WHERE w.h < {{depth}} AND NOT list_contains(w.p, e.dst))"""
_TEXT = "array_to_string(list_transform(p, lambda x: CAST(x AS VARCHAR)), '-')"
SQL["r_shortest"] = _with(USERS, FOLLOWED, _WALK.format(depth=4), recursive=True) + f"""
SELECT s AS source, t AS target, {_TEXT} AS nodes, h AS hop_count, CAST(h AS DOUBLE) AS total_cost
FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY h, p) AS k FROM w WHERE s <> t) WHERE k = 1"""
SQL["r_all_shortest"] = _with(USERS, FOLLOWED, _WALK.format(depth=4), recursive=True) + f"""
SELECT s AS source, t AS target, {_TEXT} AS nodes, h AS hop_count
FROM (SELECT *, min(h) OVER (PARTITION BY s, t) AS least FROM w WHERE s <> t) WHERE h = least"""


def _costs(rounds: int, where: str = "") -> list[str]:
    out = [f"b0 AS MATERIALIZED (SELECT DISTINCT id AS s, id, 0.0::DOUBLE AS c FROM n {where})"]
    for i in range(1, rounds + 1):
        out.append(f"b{i} AS MATERIALIZED (SELECT s, id, min(c) AS c FROM (SELECT * FROM b{i - 1} UNION ALL SELECT s, e.dst, c + weight FROM b{i - 1} q JOIN e ON e.src = q.id) GROUP BY s, id)")
    return out


SQL["r_dijkstra"] = SQL["r_astar"] = _with(USERS, FOLLOWED, *_costs(20, f"WHERE id {_FROM}")) + " SELECT s AS source, id AS target, c AS total_cost FROM b20 WHERE s <> id"
# Walks of three hops bound what the third path costs; with the distance that is left, longer ones are cut at that.
SQL["r_yen"] = _with(USERS, FOLLOWED, *_costs(20), _WALK.format(depth=3),
    "u AS MATERIALIZED (SELECT s, t, c AS most FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY c, h, p) AS k FROM w WHERE s <> t) WHERE k = 3)",
    f"g AS MATERIALIZED (SELECT b.s, b.id AS t, coalesce(most, 1e9) AS most FROM b20 b LEFT JOIN u ON u.s = b.s AND u.t = b.id WHERE b.s {_FROM} AND b.s <> b.id)",
    """y(s, t, a, p, h, c) AS (SELECT s, t, s, [s], 0, 0.0::DOUBLE FROM g
UNION ALL SELECT y.s, y.t, e.dst, list_append(y.p, e.dst), y.h + 1, y.c + e.weight FROM y JOIN e ON e.src = y.a JOIN b20 r ON r.s = e.dst AND r.id = y.t
JOIN g ON g.s = y.s AND g.t = y.t WHERE y.a <> y.t AND NOT list_contains(y.p, e.dst) AND y.c + e.weight + r.c <= g.most)""", recursive=True) + f"""
SELECT s AS source, t AS target, CAST(k AS INTEGER) AS rank, {_TEXT} AS nodes, h AS hop_count, c AS total_cost
FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY c, h, p) AS k FROM y WHERE a = t) WHERE k <= 3"""

# --- similarity ---------------------------------------------------------------------

_SETS = "f AS MATERIALIZED (SELECT DISTINCT o_custkey AS id, l_partkey % 256 AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey), z AS MATERIALIZED (SELECT id, count(*) AS n FROM f GROUP BY id)"
SQL["s_bitset_pairs"] = f"""WITH {_SETS},
p AS (SELECT a.id AS l, b.id AS r, a.n AS na, b.n AS nb FROM z a JOIN z b ON b.id = a.id + 1),
i AS (SELECT l, r, na, nb, count(y.f) AS k FROM p JOIN f x ON x.id = l LEFT JOIN f y ON y.id = r AND y.f = x.f GROUP BY ALL)
SELECT l AS "left", r AS "right", na + nb - 2 * k AS difference, k AS intersection, na + nb - k AS "union",
round((na + nb - 2 * k) / 256.0, 6) AS hamming_distance, round(1 - (na + nb - 2 * k) / 256.0, 6) AS hamming_similarity,
round(k / CAST(na + nb - k AS DOUBLE), 6) AS jaccard, round(k / sqrt(CAST(na AS DOUBLE) * nb), 6) AS cosine FROM i"""
SQL["s_similar_pairs"] = """WITH f AS MATERIALIZED (SELECT DISTINCT l_orderkey AS id, l_partkey % 4096 AS f FROM lineitem), z AS MATERIALIZED (SELECT id, count(*) AS n FROM f GROUP BY id),
i AS (SELECT x.id AS l, y.id AS r, count(*) AS k FROM f x JOIN f y ON y.f = x.f AND x.id < y.id GROUP BY 1, 2)
SELECT l AS "left", r AS "right", round(k / CAST(a.n + b.n - k AS DOUBLE), 6) AS jaccard FROM i JOIN z a ON a.id = l JOIN z b ON b.id = r
WHERE 10 * k >= 4 * (a.n + b.n - k)"""

# --- mutations ----------------------------------------------------------------------

SQL["m_apply_plan"] = """WITH c AS (
  SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'Renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey = 2 THEN 1.25 ELSE c_acctbal END AS c_acctbal
  FROM customer WHERE c_custkey <> 3 UNION ALL SELECT -5, 'New', 12.5
  UNION ALL SELECT 1, 'Renamed', NULL WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1)),
d AS (SELECT min(o_orderkey) AS gone FROM orders WHERE o_custkey = 4), m AS (SELECT min(o_orderkey) AS changed FROM orders WHERE o_custkey = 5),
p AS (SELECT o_custkey AS src, CASE WHEN o_orderkey = (SELECT changed FROM m) THEN 0.5 ELSE o_totalprice END AS price FROM orders
  WHERE o_custkey <> 3 AND NOT o_orderkey = (SELECT gone FROM d) UNION ALL SELECT -5, 9.5)
SELECT c_custkey, c_name, c_acctbal, count(src) AS n_orders, round(coalesce(sum(price), 0), 2) AS price FROM c LEFT JOIN p ON src = c_custkey GROUP BY c_custkey, c_name, c_acctbal"""
#: An undirected relation: an edge goes whichever way it is named.
SQL["m_delete_undirected"] = f"""WITH e AS ({BOUGHT}), g AS (SELECT min(src) AS s FROM e), t AS (SELECT min(dst) AS t FROM e WHERE src = (SELECT s FROM g))
SELECT src, dst, weight FROM e WHERE NOT (src = (SELECT s FROM g) AND dst = (SELECT t FROM t))"""

# --- what must hold of results that aren't unique ------------------------------------

_ALL_PARTS = "(SELECT count(*) FROM part)"
SQL["i_k1coloring"] = f"SELECT {_ALL_PARTS} AS nodes, 0::BIGINT AS conflicts, 0::BIGINT AS above_degree"
SQL["i_maxkcut"] = f"WITH e AS ({BOUGHT}) SELECT {_ALL_PARTS} AS nodes, 0::BIGINT AS wrong, true AS cuts_half"
for _name in ("i_louvain", "i_leiden", "i_modopt"):
    SQL[_name] = f"SELECT {_ALL_PARTS} AS nodes, 0::BIGINT AS wrong, 0::BIGINT AS parted, true AS better"
SQL["i_sllpa"] = f"SELECT {_ALL_PARTS} AS nodes, 0::BIGINT AS wrong, 0::BIGINT AS across"
SQL["i_kmeans"] = "SELECT count(*) AS nodes, 0::BIGINT AS farther, 0::BIGINT AS off FROM embeddings"
SQL["i_hdbscan"] = "SELECT count(*) AS nodes, 0::BIGINT AS wrong, 0::BIGINT AS small FROM embeddings"
SQL["i_celf"] = "SELECT 3::BIGINT AS seeds, true AS rising, true AS falling_gains, true AS bounded"
#: Names as keys: c_name is one for each customer, and its order is that of the numbers.
SQL["a_components_by_name"] = f"""WITH RECURSIVE o AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50),
e AS MATERIALIZED (SELECT DISTINCT a.c_name AS src, b.c_name AS dst FROM o x JOIN o y ON y.l_partkey = x.l_partkey AND y.o_custkey <> x.o_custkey
  JOIN customer a ON a.c_custkey = x.o_custkey JOIN customer b ON b.c_custkey = y.o_custkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING'),
r(id, c) AS (SELECT c_name, c_name FROM customer UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id WHERE r.c < e.dst)
SELECT id AS c_name, min(c) AS component_id FROM r GROUP BY id"""
