"""Graphs over the star-schema tables, and a query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import bitsets
from graphloom.model import ModelBuilder
from graphloom.operators import community
from graphloom.operators.components import connected_components
from graphloom.plans.analytics import projected
from graphloom.plans.lineage import written
from graphloom.session import Mutation, Op, apply_plan
from graphloom.sources.graph import Graph, with_edge_ids

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


def _followed(v: dict[str, DataFrame]) -> DataFrame:
    e = v["events"].select("event_id", "user_id", "event_type")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("next"), F.col("event_type").alias("what"))
    hit = e.join(after.filter("what = 'error'"), "event_id").filter("user_id <> next")
    return hit.groupBy(F.col("user_id").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("weight"))


def _bought(v: dict[str, DataFrame]) -> DataFrame:
    a = v["lineitem"].filter("l_quantity >= 45").select("l_orderkey", F.col("l_partkey").alias("src"))
    b = a.withColumnRenamed("src", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _returned(v: dict[str, DataFrame]) -> DataFrame:
    items = v["lineitem"].filter("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey", "l_suppkey")
    owners = v["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return items.join(owners, "l_orderkey").select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations, regions, users and vectors with their relations."""
    v = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    nodes = {
        "Customer": v["customer"].withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).withColumn("rich", F.col("c_acctbal") > 5000),
        "Supplier": v["supplier"],
        "Part": v["part"].withColumn("shelf", F.col("p_size") % 5),
        "Order": v["orders"],
        "Nation": v["nation"],
        "Region": v["region"],
        "User": v["events"].select("user_id").distinct().withColumn("lat", (F.col("user_id") % 180 - 90).cast("double")).withColumn("lon", (F.col("user_id") * 7 % 360 - 180).cast("double")),
    }
    keys = {"Customer": "c_custkey", "Supplier": "s_suppkey", "Part": "p_partkey", "Order": "o_orderkey", "Nation": "n_nationkey", "Region": "r_regionkey", "User": "user_id"}
    edges = {
        ("Customer", "PLACED", "Order"): (v["orders"].select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_orderdate", "o_totalprice"), True),
        ("Order", "CONTAINS", "Part"): (v["lineitem"].select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity", "l_returnflag"), True),
        ("Customer", "CUSTOMER_IN", "Nation"): (v["customer"].select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), True),
        ("Supplier", "SUPPLIER_IN", "Nation"): (v["supplier"].select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst")), True),
        ("Nation", "NATION_IN", "Region"): (v["nation"].select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), True),
        ("Customer", "RETURNED_FROM", "Supplier"): (_returned(v), True),
        ("Customer", "ORDERED_HIGH", "Order"): (v["orders"].filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), True),
        ("Customer", "ORDERED_OPEN", "Order"): (v["orders"].filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), True),
        ("User", "FOLLOWED_BY", "User"): (_followed(v), True),
        ("Part", "BOUGHT_WITH", "Part"): (_bought(v), False),
    }
    b = ModelBuilder()
    for label, table in nodes.items():
        b.node(label, table.columns, key=keys[label])
    for (s, n, t), (table, directed) in edges.items():
        b.relation(n, s, t, table.columns, directed)
    # Relations of a table whose key tells the edges apart get ids from their ends alone.
    unique = {"PLACED", "CUSTOMER_IN", "SUPPLIER_IN", "NATION_IN", "RETURNED_FROM", "ORDERED_HIGH", "ORDERED_OPEN", "FOLLOWED_BY", "BOUGHT_WITH"}
    tables = {k: (t.withColumn("edge_id", F.xxhash64("src", "dst", F.lit(k[1]))) if k[1] in unique else with_edge_ids(t)) for k, (t, _) in edges.items()}
    return Graph(spark, b.build(), nodes, tables)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(star_graph(spark, sf_dir))
    return f


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to 6 digits, where sums are added in another order."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns))


# --- filters ------------------------------------------------------------------------


@_query
def q_filter_take(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: c.c_mktsegment == "BUILDING").order_by("c_custkey").take(50).select("c_custkey", "c_name", "c_mktsegment").to_df()


@_query
def q_traverse_out(g: Graph) -> DataFrame:
    """Orders of one segment above a price."""
    found = g.nodes("Customer").where(lambda c: c.c_mktsegment == "BUILDING").traverse(g.relation("PLACED")).where(lambda o: o.o_totalprice >= 300000)
    return found.order_by("o_totalprice", descending=True).then_by("o_orderkey").take(100).select("o_orderkey", "o_totalprice", "o_orderstatus").to_df()


@_query
def p_compare(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: (c.c_acctbal > 1000) & (c.c_acctbal <= 5000) & (c.c_nationkey != 3) & (c.c_custkey >= 10)).select("c_custkey", "c_acctbal").to_df()


@_query
def p_null(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: (c.balance == None) | (c.balance > 9000)).select("c_custkey", "balance").to_df()  # noqa: E711


@_query
def p_not_null(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: c.balance != None).where(lambda c: c.balance < 500).select("c_custkey").to_df()  # noqa: E711


@_query
def p_logical_not(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: ~((c.c_acctbal > 0) | (c.c_mktsegment == "BUILDING"))).select("c_custkey").to_df()


@_query
def p_null_logic(g: Graph) -> DataFrame:
    """Unequal and negated comparisons leave nulls out."""
    return g.nodes("Customer").where(lambda c: ~(c.balance > 2000) | (c.balance != 7.5)).select("c_custkey").to_df()


@_query
def p_bool(g: Graph) -> DataFrame:
    return g.nodes("Customer").where(lambda c: c.rich & ~(c.c_nationkey < 20)).select("c_custkey", "rich").to_df()


@_query
def p_string(g: Graph) -> DataFrame:
    return g.nodes("Part").where(lambda p: p.p_type.startswith("PROMO") | p.p_name.contains("1%") | p.p_brand.endswith("3")).select("p_partkey", "p_type", "p_brand").to_df()


@_query
def p_not_in(g: Graph) -> DataFrame:
    return g.nodes("Order").where(lambda o: o.o_orderstatus.not_in(["O", "F"])).select("o_orderkey", "o_orderstatus").to_df()


# --- shape --------------------------------------------------------------------------


@_query
def t_order_then(g: Graph) -> DataFrame:
    return g.nodes("Customer").order_by("c_mktsegment").then_by("c_acctbal", descending=True).then_by("c_custkey").take(40).select("c_custkey", "c_mktsegment", "c_acctbal").to_df()


@_query
def t_order_nulls(g: Graph) -> DataFrame:
    """Nulls come first in falling order."""
    return g.nodes("Customer").order_by("balance", descending=True).then_by("c_custkey").take(200).select("c_custkey", "balance").to_df()


@_query
def t_skip_take(g: Graph) -> DataFrame:
    """Flags, not a pipeline: the later filter still comes first."""
    return g.nodes("Part").take(5).take(20).order_by("p_retailprice").then_by("p_partkey").skip(30).where(lambda p: p.p_size > 10).select("p_partkey", "p_retailprice").to_df()


@_query
def t_count(g: Graph) -> DataFrame:
    return g.nodes("Order").where(lambda o: o.o_totalprice > 100000).order_by("o_orderkey").count_df()


@_query
def t_count_distinct(g: Graph) -> DataFrame:
    return g.nodes("Customer").traverse(g.relation("PLACED")).where(lambda o: o.o_totalprice > 200000).traverse(g.relation("CONTAINS")).distinct().count_df()


@_query
def t_count_page(g: Graph) -> DataFrame:
    return g.nodes("Region").skip(2).take(10).count_df()


@_query
def t_any(g: Graph) -> DataFrame:
    found = g.nodes("Customer").where(lambda c: c.c_acctbal > 9990).any()
    none = g.nodes("Customer").where(lambda c: c.c_acctbal > 1e12).any()
    return g.spark.createDataFrame([(bool(found), bool(none))], "some boolean, none boolean")


@_query
def t_first(g: Graph) -> DataFrame:
    row = g.nodes("Supplier").order_by("s_acctbal", descending=True).then_by("s_suppkey").select("s_suppkey", "s_acctbal").first()
    return g.spark.createDataFrame([row], "s_suppkey long, s_acctbal double")


@_query
def t_single(g: Graph) -> DataFrame:
    row = g.nodes("Nation").where(lambda n: n.n_nationkey == 7).select("n_nationkey", "n_name").single()
    return g.spark.createDataFrame([row], "n_nationkey int, n_name string")


@_query
def t_select(g: Graph) -> DataFrame:
    return g.nodes("Supplier").select("s_name").to_df()


# --- traversals ---------------------------------------------------------------------


@_query
def x_incoming(g: Graph) -> DataFrame:
    return g.nodes("Nation").where(lambda n: n.n_nationkey.is_in([1, 2])).traverse_incoming(g.relation("CUSTOMER_IN")).where(lambda c: c.c_acctbal > 0).select("c_custkey", "c_nationkey").to_df()


@_query
def x_chain3(g: Graph) -> DataFrame:
    found = g.nodes("Customer").where(lambda c: c.c_mktsegment == "MACHINERY").traverse(g.relation("PLACED")).where(lambda o: o.o_totalprice > 250000)
    return found.traverse(g.relation("CONTAINS")).where(lambda p: p.p_size < 10).select("p_partkey", "p_size").to_df()


@_query
def x_optional_count(g: Graph) -> DataFrame:
    return g.nodes("Customer").traverse_optional(g.relation("RETURNED_FROM")).count_df()


@_query
def x_optional_required(g: Graph) -> DataFrame:
    """A step that must match, after a miss, matches nothing."""
    return g.nodes("Customer").traverse_optional(g.relation("RETURNED_FROM")).traverse(g.relation("SUPPLIER_IN")).select("n_nationkey", "n_name").to_df()


@_query
def x_var_depth_distinct(g: Graph) -> DataFrame:
    return g.nodes("User").traverse(g.relation("FOLLOWED_BY"), 1, 4).distinct().select("user_id").to_df()


@_query
def x_raw_sql(g: Graph) -> DataFrame:
    return g.sql("SELECT c_mktsegment, count(*) AS n FROM Customer WHERE c_acctbal > :least GROUP BY c_mktsegment", least=1000.0)


@_query
def p_in(g: Graph) -> DataFrame:
    return g.nodes("Order").where(lambda o: o.o_orderpriority.is_in(["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority").to_df()


@_query
def t_distinct(g: Graph) -> DataFrame:
    return g.nodes("Customer").traverse(g.relation("PLACED")).traverse(g.relation("CONTAINS")).distinct().select("p_partkey", "p_name").to_df()


@_query
def x_undirected(g: Graph) -> DataFrame:
    return g.nodes("Part").traverse(g.relation("BOUGHT_WITH")).select("p_partkey", "p_size").to_df()


@_query
def x_undirected_2(g: Graph) -> DataFrame:
    """Two steps over one relation don't go back over the same edge."""
    return g.nodes("Part").traverse(g.relation("BOUGHT_WITH")).traverse(g.relation("BOUGHT_WITH")).select("p_partkey").to_df()


@_query
def x_optional(g: Graph) -> DataFrame:
    """Targets only: a miss has no target."""
    return g.nodes("Customer").traverse_optional(g.relation("RETURNED_FROM")).where(lambda s: s.s_acctbal > 0).select("s_suppkey", "s_acctbal").to_df()


@_query
def x_any(g: Graph) -> DataFrame:
    return g.nodes("Customer").traverse_any(g.relation("ORDERED_HIGH"), g.relation("ORDERED_OPEN")).select("o_orderkey").to_df()


@_query
def x_path(g: Graph) -> DataFrame:
    found = g.nodes("Customer").traverse_path(g.relation("PLACED")).to_df()
    return found.select(F.col("source.c_custkey").alias("c_custkey"), F.col("relation.o_totalprice").alias("price"), F.col("target.o_orderkey").alias("o_orderkey"))


@_query
def x_where_relation(g: Graph) -> DataFrame:
    found = g.nodes("Order").traverse_path(g.relation("CONTAINS")).where_relation(lambda r: r.l_quantity >= 45).where_target(lambda p: p.p_size > 25).to_df()
    return found.select(F.col("source.o_orderkey").alias("o_orderkey"), F.col("relation.l_quantity").alias("quantity"), F.col("target.p_partkey").alias("p_partkey"))


@_query
def x_var_depth(g: Graph) -> DataFrame:
    """Paths of one to three different edges."""
    return g.nodes("User").traverse(g.relation("FOLLOWED_BY"), 1, 3).select("user_id").to_df()


@_query
def x_zero_depth(g: Graph) -> DataFrame:
    return g.nodes("User").traverse(g.relation("FOLLOWED_BY"), 0, 1).select("user_id").to_df()


@_query
def x_simple_path(g: Graph) -> DataFrame:
    return g.nodes("User").traverse(g.relation("FOLLOWED_BY"), 2, 3).without_cycles().select("user_id").to_df()


@_query
def x_subgraph_nodes(g: Graph) -> DataFrame:
    nodes, _ = g.nodes("Customer").traverse(g.relation("PLACED")).traverse(g.relation("CONTAINS")).to_subgraph()
    return nodes.select("label", "id")


@_query
def x_subgraph_edges(g: Graph) -> DataFrame:
    _, edges = g.nodes("Customer").traverse(g.relation("PLACED")).traverse(g.relation("CONTAINS")).to_subgraph()
    price, quantity = (F.get_json_object("properties", f"$.{p}").cast("double") for p in ("o_totalprice", "l_quantity"))
    return edges.select("relation", "source_id", "target_id", F.round(price, 2).alias("price"), quantity.alias("quantity"))


# --- analytics ----------------------------------------------------------------------


def _users(g: Graph, **where):
    return g.nodes("User").analyze(g.relation("FOLLOWED_BY"))


def _parts(g: Graph):
    return g.nodes("Part").analyze(g.relation("BOUGHT_WITH"))


@_query
def a_degree(g: Graph) -> DataFrame:
    return _r(_users(g).degree().weighted_by("weight").to_df().select("user_id", "score"), "score")


@_query
def a_pagerank(g: Graph) -> DataFrame:
    return _r(_users(g).pagerank(tolerance=None).to_df().select("user_id", "score"), "score")


@_query
def a_pagerank_top(g: Graph) -> DataFrame:
    """The predicate filters afterwards, then the ten best are taken."""
    found = g.nodes("User").where(lambda u: u.lat > -70).analyze(g.relation("FOLLOWED_BY")).pagerank(tolerance=None, iterations=10).weighted_by("weight").top(10)
    return _r(found.to_df().select("user_id", "score"), "score")


@_query
def a_articlerank(g: Graph) -> DataFrame:
    return _r(_users(g).article_rank(tolerance=None).to_df().select("user_id", "score"), "score")


@_query
def a_eigenvector(g: Graph) -> DataFrame:
    return _r(_users(g).eigenvector(iterations=10).to_df().select("user_id", "score"), "score")


@_query
def a_hits(g: Graph) -> DataFrame:
    return _r(_users(g).hits(iterations=6).to_df().select("user_id", "auth", "hub"), "auth", "hub")


@_query
def a_closeness(g: Graph) -> DataFrame:
    return _r(_users(g).closeness().to_df().select("user_id", "score"), "score")


@_query
def a_harmonic(g: Graph) -> DataFrame:
    return _r(_users(g).harmonic().to_df().select("user_id", "score"), "score")


@_query
def a_betweenness(g: Graph) -> DataFrame:
    return _r(_users(g).betweenness().to_df().select("user_id", "score"), "score")


@_query
def a_celf(g: Graph) -> DataFrame:
    return _users(g).celf(seeds=3, simulations=10).to_df().select("user_id", "spread")


@_query
def a_wcc(g: Graph) -> DataFrame:
    return _parts(g).wcc().to_df().select("p_partkey", "component_id")


@_query
def a_scc(g: Graph) -> DataFrame:
    return _users(g).scc().to_df().select("user_id", "component_id")


@_query
def a_triangles(g: Graph) -> DataFrame:
    return _parts(g).triangle_count().to_df().select("p_partkey", "triangle_count")


@_query
def a_lcc(g: Graph) -> DataFrame:
    return _r(_parts(g).local_clustering().to_df().select("p_partkey", "local_clustering_coefficient"), "local_clustering_coefficient")


@_query
def a_cliques(g: Graph) -> DataFrame:
    return _users(g).clique_counting(max_k=4).to_df().select("user_id", "clique_count", "max_clique_size")


@_query
def a_kcore(g: Graph) -> DataFrame:
    return _parts(g).kcore().to_df().select("p_partkey", "core_value")


@_query
def a_lpa(g: Graph) -> DataFrame:
    return _parts(g).label_propagation(iterations=5).weighted_by("weight").to_df().select("p_partkey", "community_id")


@_query
def a_modularity(g: Graph) -> DataFrame:
    return _r(_parts(g).modularity(community_property="shelf").weighted_by("weight").to_df().select("community_id", "modularity"), "modularity")


@_query
def a_conductance(g: Graph) -> DataFrame:
    return _r(_parts(g).conductance(community_property="shelf").weighted_by("weight").to_df().select("community_id", "conductance"), "conductance")


@_query
def a_louvain(g: Graph) -> DataFrame:
    return _parts(g).louvain(levels=3, iterations=4).weighted_by("weight").to_df().select("p_partkey", "community_id")


@_query
def a_k1coloring(g: Graph) -> DataFrame:
    return _parts(g).k1_coloring().to_df().select("p_partkey", "color")


@_query
def a_articulation(g: Graph) -> DataFrame:
    return _parts(g).articulation_points().to_df().select("p_partkey", "resulting_components")


@_query
def a_bridges(g: Graph) -> DataFrame:
    found = _parts(g).bridges().to_df()
    return found.select("from", "to", F.col("remaining_sizes")[0].alias("size_from"), F.col("remaining_sizes")[1].alias("size_to"))


@_query
def a_leiden(g: Graph) -> DataFrame:
    return _parts(g).leiden(levels=2, iterations=3).to_df().select("p_partkey", "community_id")


@_query
def a_modopt(g: Graph) -> DataFrame:
    return _parts(g).modularity_optimization(iterations=3).to_df().select("p_partkey", "community_id")


@_query
def a_maxkcut(g: Graph) -> DataFrame:
    return _parts(g).max_k_cut(k=2, iterations=3).to_df().select("p_partkey", "community_id")


@_query
def a_sllpa(g: Graph) -> DataFrame:
    found = _parts(g).sllpa(iterations=4).to_df()
    return found.select("p_partkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("communities"))


def _vectors(spark: SparkSession, sf_dir: str) -> Graph:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = ModelBuilder().node("Vector", ["vec_id", "label"], key="vec_id").build()
    return Graph(spark, model, {"Vector": table}, {})


def a_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.clusters import kmeans

    g = _vectors(spark, sf_dir)
    found = kmeans(g.node_table("Vector").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k=5)
    return found.select(F.col("id").alias("vec_id"), "community_id", F.round("distance_from_centroid", 6).alias("distance"))


def a_hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.clusters import hdbscan

    g = _vectors(spark, sf_dir)
    found = hdbscan(g.node_table("Vector").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return found.select(F.col("id").alias("vec_id"), "cluster_id", F.round("probability", 6).alias("probability"))


QUERIES |= {"a_kmeans": a_kmeans, "a_hdbscan": a_hdbscan}


# --- routes -------------------------------------------------------------------------


def _ends(g: Graph):
    """Every fiftieth user, and all users."""
    ids = [r.user_id for r in g.node_table("User").filter("user_id % 50 = 0").select("user_id").collect()]
    return g.nodes("User").where(lambda u: u.user_id.is_in(ids)), g.nodes("User")


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), "-"))


@_query
def r_shortest(g: Graph) -> DataFrame:
    a, b = _ends(g)
    return _joined(a.shortest_path_to(b, g.relation("FOLLOWED_BY")).max_depth(4).to_df()).select("source", "target", "nodes", "hop_count", "total_cost")


@_query
def r_all_shortest(g: Graph) -> DataFrame:
    a, b = _ends(g)
    return _joined(a.shortest_path_to(b, g.relation("FOLLOWED_BY")).all_shortest().max_depth(4).to_df()).select("source", "target", "nodes", "hop_count")


@_query
def r_dijkstra(g: Graph) -> DataFrame:
    a, b = _ends(g)
    return a.shortest_path_to(b, g.relation("FOLLOWED_BY")).weighted_by("weight").dijkstra().costs_only().to_df().select("source", "target", "total_cost")


@_query
def r_astar(g: Graph) -> DataFrame:
    a, b = _ends(g)
    found = a.shortest_path_to(b, g.relation("FOLLOWED_BY")).weighted_by("weight").a_star("lat", "lon", scale=1 / 50_000).costs_only()
    return found.to_df().select("source", "target", "total_cost")


@_query
def r_yen(g: Graph) -> DataFrame:
    """Routes of any number of hops."""
    a, b = _ends(g)
    return _joined(a.shortest_path_to(b, g.relation("FOLLOWED_BY")).weighted_by("weight").yen(3).to_df()).select("source", "target", "rank", "nodes", "hop_count", "total_cost")


# --- similarity ---------------------------------------------------------------------

WIDTH = 256


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bit vector of ordered parts for each customer."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = items.join(orders, "l_orderkey").select(F.col("o_custkey").alias("customer"), (F.col("l_partkey") % WIDTH).alias("feature"))
    return bitsets.bit_vectors(rows, "customer", "feature", WIDTH)


def s_bitset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring customers compared."""
    vectors = _baskets(spark, sf_dir)
    pairs = vectors.select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    found = bitsets.compare_pairs(pairs, vectors, WIDTH)
    return _r(found, "hamming_distance", "hamming_similarity", "jaccard", "cosine")


#: Bits of an order's vector; there are more parts than of a customer's.
WIDE = 4096


def s_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with about the same parts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % WIDE).alias("feature"))
    return _r(bitsets.similar_pairs(bitsets.bit_vectors(items, "l_orderkey", "feature", WIDE), WIDE, 0.4), "jaccard")


QUERIES |= {"s_bitset_pairs": s_bitset_pairs, "s_similar_pairs": s_similar_pairs}


# --- mutations ----------------------------------------------------------------------


@_query
def m_apply_plan(g: Graph) -> DataFrame:
    """Nodes and relations after a plan: an upsert, a new node, updates, misses and deletes."""
    placed = ("Customer", "PLACED", "Order")
    first = g.node_table("Order").filter("o_custkey in (4, 5)").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).collect()
    order = {r.o_custkey: r.o for r in first}
    after = apply_plan(
        g,
        [
            Mutation(Op.DELETE_NODE, "Customer", 3),
            Mutation(Op.ADD_NODE, "Customer", 1, values={"c_custkey": 1, "c_name": "Renamed"}),
            Mutation(Op.ADD_NODE, "Customer", -5, values={"c_custkey": -5, "c_name": "New", "c_acctbal": 12.5}),
            Mutation(Op.MODIFY_NODE, "Customer", 2, values={"c_acctbal": 1.25}),
            Mutation(Op.MODIFY_NODE, "Customer", -99, values={"c_acctbal": 1.0}),
            Mutation(Op.ADD_RELATION, "PLACED", src=-5, dst=1, values={"o_totalprice": 9.5}, relation=placed),
            Mutation(Op.MODIFY_RELATION, "PLACED", src=5, dst=order.get(5, -1), values={"o_totalprice": 0.5}, relation=placed),
            Mutation(Op.DELETE_RELATION, "PLACED", src=4, dst=order.get(4, -1), relation=placed),
            Mutation(Op.DELETE_RELATION, "PLACED", src=2, dst=-1, relation=placed),
        ],
    )
    own = after.node_tables["Customer"].select("c_custkey", "c_name", "c_acctbal")
    count = after.edge_tables[placed].groupBy(F.col("src").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"))
    return own.join(count, "c_custkey", "left").select(
        "c_custkey", "c_name", "c_acctbal", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("p", F.lit(0.0)), 2).alias("price")
    )


@_query
def m_delete_undirected(g: Graph) -> DataFrame:
    """An edge of an undirected relation is deleted by its ends in the other order."""
    bought = ("Part", "BOUGHT_WITH", "Part")
    one = g.edge_tables[bought].orderBy("src", "dst").first()
    after = apply_plan(g, [Mutation(Op.DELETE_RELATION, "BOUGHT_WITH", src=one.dst, dst=one.src, relation=bought)] if one else [])
    return after.edge_tables[bought].select("src", "dst", "weight")


# --- names as keys --------------------------------------------------------------------


def a_components_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment that bought a part in bulk, joined by it; keys are names."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    people = read("customer").select("c_custkey", "c_name", "c_mktsegment")
    bulk = read("lineitem").filter("l_quantity >= 50").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    own = bulk.join(people.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("l_partkey", "c_name")
    # Each buyer of a part with its first one: the same components as all pairs have.
    first = own.groupBy("l_partkey").agg(F.min("c_name").alias("src"))
    edges = own.join(first, "l_partkey").filter("src <> c_name").select("src", F.col("c_name").alias("dst")).distinct().withColumn("edge_id", F.xxhash64("src", "dst"))
    model = ModelBuilder().node("Buyer", ["c_name"], key="c_name").relation("BOUGHT_LIKE", "Buyer", "Buyer", edges.columns, False).build()
    g = Graph(spark, model, {"Buyer": people.select("c_name")}, {("Buyer", "BOUGHT_LIKE", "Buyer"): edges})
    return g.nodes("Buyer").analyze(g.relation("BOUGHT_LIKE")).wcc().to_df().select("c_name", "component_id")


QUERIES["a_components_by_name"] = a_components_by_name


# --- what must hold of results that aren't unique ---------------------------------------


def _labelled(g: Graph, found: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(id, c) written, and BOUGHT_WITH with the labels of both ends."""
    labels = written(found.select(F.col("p_partkey").alias("id"), F.col(column).alias("c")), "labels")
    edges = g.edge_table(g.model.relations["Part", "BOUGHT_WITH", "Part"]).select("src", "dst", "weight")
    return labels, edges.join(labels.toDF("src", "cs"), "src").join(labels.toDF("dst", "cd"), "dst")


@_query
def i_k1coloring(g: Graph) -> DataFrame:
    """Neighbours differ, and a colour is at most the number of neighbours."""
    labels, edges = _labelled(g, _parts(g).k1_coloring().to_df(), "color")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("d"))
    above = labels.join(ends, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("c") > F.coalesce("d", F.lit(0))).alias("above_degree"))
    return above.crossJoin(edges.agg(F.count_if(F.expr("cs = cd")).alias("conflicts"))).select("nodes", "conflicts", "above_degree")  # one row each


@_query
def i_maxkcut(g: Graph) -> DataFrame:
    """Two parts, and at least half of the edges between them."""
    labels, edges = _labelled(g, _parts(g).max_k_cut(k=2, iterations=3).to_df(), "community_id")
    cut = edges.agg((F.count_if(F.expr("cs <> cd")) * 2 >= F.count("*")).alias("cuts_half"))
    return labels.agg(F.count("*").alias("nodes"), F.count_if(F.expr("not c in (0, 1)")).alias("wrong")).crossJoin(cut)  # one row each


def _communities(g: Graph, found: DataFrame, connected: bool) -> DataFrame:
    """Every node once, named by a node; connected if asked for; and a modularity above that of single nodes."""
    labels, edges = _labelled(g, found, "community_id")
    parts = g.node_table("Part").select(F.col("p_partkey").alias("c"))
    wrong = labels.join(parts, "c", "left_anti").count()
    parted = 0
    if connected:
        inside = connected_components(edges.filter("cs = cd"), "src", "dst")
        split = labels.join(inside, "id", "left").groupBy("c").agg(F.count_distinct(F.coalesce("component", "id")).alias("n"))
        parted = split.filter("n > 1").count()
    p = projected(g, ("Part", "BOUGHT_WITH", "Part"), "weight")
    value = community.modularity(p, labels.select("id", F.col("c").alias("community"))).agg(F.sum("modularity")).first()[0]
    alone = community.modularity(p, labels.select("id", F.col("id").alias("community"))).agg(F.sum("modularity")).first()[0]
    return labels.agg(F.count("*").alias("nodes")).select("nodes", F.lit(wrong).cast("long").alias("wrong"), F.lit(parted).cast("long").alias("parted"), F.lit(value > alone).alias("better"))


@_query
def i_louvain(g: Graph) -> DataFrame:
    return _communities(g, _parts(g).louvain(levels=3, iterations=4).weighted_by("weight").to_df(), connected=False)


@_query
def i_leiden(g: Graph) -> DataFrame:
    return _communities(g, _parts(g).leiden(levels=2, iterations=3).to_df(), connected=True)


@_query
def i_modopt(g: Graph) -> DataFrame:
    return _communities(g, _parts(g).modularity_optimization(iterations=3).to_df(), connected=False)


@_query
def i_sllpa(g: Graph) -> DataFrame:
    """Every node has a community; each is named by a node of its own component."""
    found = written(_parts(g).sllpa(iterations=4).to_df().select(F.col("p_partkey").alias("id"), F.col("values").alias("v")), "labels")
    whole = community.wcc(projected(g, ("Part", "BOUGHT_WITH", "Part"), None))
    named = found.select("id", F.explode("v").alias("c")).join(whole.toDF("id", "of"), "id").join(whole.toDF("c", "at"), "c", "left")
    across = named.filter("not (of <=> at)").count()
    return found.agg(F.count("*").alias("nodes"), F.count_if(F.size("v") == 0).alias("wrong")).withColumn("across", F.lit(across).cast("long"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors


def i_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No vector is nearer to the mean of another cluster's vectors than its distance says, by more than the last move of a mean."""
    from graphloom.operators.clusters import kmeans

    vectors = _nearest(spark, sf_dir)
    found = written(kmeans(vectors, k=5, iterations=100), "clusters").join(vectors, "id")
    each = found.select("community_id", F.posexplode(F.col("vector").cast("array<double>")).alias("at", "x")).groupBy("community_id", "at").agg(F.avg("x").alias("x"))
    means = each.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))  # k rows
    gap = F.sqrt(F.aggregate(F.zip_with(F.col("vector").cast("array<double>"), "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda n, x: n + x))
    to = found.select("id", F.col("community_id").alias("own"), "distance_from_centroid", "vector").join(F.broadcast(means), F.lit(True)).select("id", "own", "community_id", "distance_from_centroid", gap.alias("gap"))
    per = to.groupBy("id").agg(F.min("gap").alias("least"), F.max(F.when(F.col("own") == F.col("community_id"), F.col("gap"))).alias("mine"), F.first("distance_from_centroid").alias("said"))
    return per.agg(F.count("*").alias("nodes"), F.count_if(F.expr("mine > least + 1e-3")).alias("farther"), F.count_if(F.expr("abs(mine - said) > 1e-3")).alias("off"))


def i_hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities lie in [0, 1], noise has none, and no cluster is smaller than asked for."""
    from graphloom.operators.clusters import hdbscan

    found = written(hdbscan(_nearest(spark, sf_dir), min_cluster_size=5), "clusters")
    small = found.filter("cluster_id >= 0").groupBy("cluster_id").count().filter("count < 5").count()
    wrong = F.count_if(F.expr("probability < 0 or probability > 1 or (cluster_id < 0) <> (probability = 0)"))
    return found.agg(F.count("*").alias("nodes"), wrong.alias("wrong")).withColumn("small", F.lit(small).cast("long"))


@_query
def i_celf(g: Graph) -> DataFrame:
    """Different seeds; the spread rises by less each time and never exceeds the number of nodes."""
    rows = [(r.user_id, r.spread) for r in _users(g).celf(seeds=3, simulations=10).to_df().select("user_id", "spread").collect()]
    spread = sorted(s for _, s in rows)
    gains = [b - a for a, b in zip([0.0, *spread], spread, strict=False)]
    n = g.node_table("User").count()
    row = (len({u for u, _ in rows}), all(x > 0 for x in gains), all(a >= b - 1e-9 for a, b in zip(gains, gains[1:], strict=False)), bool(spread) and spread[-1] <= n)
    return g.spark.createDataFrame([row], "seeds long, rising boolean, falling_gains boolean, bounded boolean")


QUERIES |= {"i_kmeans": i_kmeans, "i_hdbscan": i_hdbscan}
