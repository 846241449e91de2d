"""Graph algorithms by name: builders, options, capabilities, projections.

An algorithm runs on the whole projected relation.  The predicate on the nodes
filters its rows afterwards; then rows are ordered by ``score`` if there is
one, and ``top`` takes the first, with the node's key to break ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.functions.predicates import to_column
from graphloom.model import NUMERIC, NodeType, RelationType
from graphloom.operators import centrality, clusters, community, paths, structure
from graphloom.operators.projection import Projected, project
from graphloom.plans.ir import AnalyticsModel, RouteModel
from graphloom.plans.lineage import scratch
from graphloom.sources.graph import Graph


class UnsupportedAnalytics(ValueError):
    """An algorithm or option that can't be used; raised before anything runs."""


class Family(Enum):
    CENTRALITY = "centrality"
    COMMUNITY = "community"
    PATH = "path"


class Availability(Enum):
    NATIVE = "native"


@dataclass(frozen=True)
class Algorithm:
    name: str
    family: Family
    metrics: tuple[str, ...]
    weighted: bool
    has_node: bool
    run: Callable[..., DataFrame] | None
    #: Options that the algorithm takes besides the weight.
    options: tuple[str, ...] = ()
    #: Options that must be given.
    needs: tuple[str, ...] = ()
    availability: Availability = Availability.NATIVE


RANK = ("damping", "iterations", "tolerance")
LEVELS = ("levels", "iterations", "tolerance", "resolution", "intermediate")


def _c(name, metrics, weighted, run, options=(), needs=()):
    return Algorithm(name, Family.CENTRALITY, metrics, weighted, True, run, options, needs)


def _m(name, metrics, weighted, run, options=(), needs=(), has_node=True):
    return Algorithm(name, Family.COMMUNITY, metrics, weighted, has_node, run, options, needs)


def _r(name, weighted):
    return Algorithm(name, Family.PATH, ("nodes", "hop_count", "total_cost"), weighted, False, None)


ALGORITHMS: dict[str, Algorithm] = {
    a.name: a
    for a in [
        _c("article_rank", ("score",), True, centrality.article_rank, RANK),
        _c("articulation_points", ("resulting_components",), False, structure.articulation_points),
        _c("betweenness", ("score",), True, centrality.betweenness),
        replace(_c("bridges", ("from", "to", "remaining_sizes"), False, structure.bridges), has_node=False),
        _c("celf", ("spread",), True, centrality.celf, ("seeds", "probability", "simulations", "seed")),
        _c("closeness", ("score",), True, centrality.closeness),
        _c("degree", ("score",), True, centrality.degree),
        _c("eigenvector", ("score",), True, centrality.eigenvector, ("iterations",)),
        _c("harmonic", ("score",), False, centrality.harmonic),
        _c("hits", ("auth", "hub", "values"), False, centrality.hits, ("iterations",)),
        _c("pagerank", ("score",), True, centrality.pagerank, RANK),
        _m("clique_counting", ("clique_count", "max_clique_size"), False, community.clique_counting, ("max_k",)),
        _m("conductance", ("community_id", "conductance"), True, community.conductance, ("community_property",), ("community_property",), False),
        _m("hdbscan", ("cluster_id", "probability", "outlier_score"), False, clusters.hdbscan, ("node_property", "min_samples", "min_cluster_size"), ("node_property",)),
        _m("kcore", ("core_value",), False, community.kcore),
        _m("k1_coloring", ("color",), False, community.k1_coloring),
        _m("kmeans", ("community_id", "distance_from_centroid"), False, clusters.kmeans, ("node_property", "k", "iterations", "seed"), ("node_property",)),
        _m("label_propagation", ("community_id",), True, community.label_propagation, ("iterations",)),
        _m("leiden", ("community_id",), True, community.leiden, LEVELS),
        _m("local_clustering", ("local_clustering_coefficient",), False, community.local_clustering),
        _m("louvain", ("community_id",), True, community.louvain, LEVELS),
        _m("modularity", ("community_id", "modularity"), True, community.modularity, ("community_property", "resolution"), ("community_property",), False),
        _m("modularity_optimization", ("community_id",), True, community.modularity_optimization, ("iterations", "tolerance", "resolution")),
        _m("scc", ("component_id",), False, community.scc),
        _m("triangle_count", ("triangle_count",), False, community.triangle_count),
        _m("wcc", ("component_id",), False, community.wcc),
        _m("max_k_cut", ("community_id",), False, community.max_k_cut, ("k", "iterations")),
        _m("sllpa", ("values",), False, community.sllpa, ("iterations", "threshold", "seed")),
        _r("shortest_path", False),
        _r("all_shortest_paths", False),
        _r("dijkstra", True),
        _r("a_star", True),
        _r("yen", True),
    ]
}
#: Algorithms that sum over communities or points given by a node property.
_BY_PROPERTY = {"conductance", "modularity"}
_BY_VECTOR = {"hdbscan", "kmeans"}
#: Algorithms that take a switch for weights instead of weighted arcs alone.
_WEIGHT_SWITCH = {"betweenness", "closeness", "celf"}


class Capabilities:
    """What can be run here."""

    @staticmethod
    def supports(algorithm: str) -> bool:
        return algorithm in ALGORITHMS

    @staticmethod
    def details(algorithm: str) -> Algorithm:
        if algorithm not in ALGORITHMS:
            raise UnsupportedAnalytics(f"no algorithm {algorithm}")
        return ALGORITHMS[algorithm]

    @staticmethod
    def all() -> list[Algorithm]:
        return list(ALGORITHMS.values())


def numeric_property(graph: Graph, relation: RelationType, prop: str) -> str:
    column = relation.column(prop)
    kind = graph.edge_table(relation).schema[column].dataType
    if not isinstance(kind, NUMERIC):
        raise UnsupportedAnalytics(f"{prop} is no number")
    return column


# --- projections --------------------------------------------------------------------


@dataclass(frozen=True)
class ProjectionDefinition:
    name: str
    node_type: str
    relation: tuple[str, str, str]
    directed: bool
    weight: str | None = None


class Projections:
    """Named projections of a graph, kept until they are dropped."""

    def __init__(self, graph: Graph) -> None:
        self.graph = graph

    def discover(self) -> list[ProjectionDefinition]:
        return [d for d, _ in self.graph.projections.values()]  # type: ignore[misc]

    def ensure(self, definition: ProjectionDefinition) -> Projected:
        """Made unless the name is there; then what is there is returned, whatever its definition."""
        held = self.graph.projections
        if definition.name not in held:
            relation = self.graph.model.relations[definition.relation]
            weight = numeric_property(self.graph, relation, definition.weight) if definition.weight else None
            held[definition.name] = (definition, projected(self.graph, definition.relation, weight, definition.directed))
        return held[definition.name][1]  # type: ignore[index]

    def drop(self, name: str) -> None:
        self.graph.projections.pop(name, None)


def projected(graph: Graph, relation: tuple[str, str, str], weight: str | None, directed: bool | None = None) -> Projected:
    kind = graph.model.relations[relation]
    node = graph.model.node(kind.source)
    nodes = graph.node_table(kind.source).select(F.col(node.key_column).alias("id"))
    return project(nodes, graph.edge_table(relation), kind.directed if directed is None else directed, weight)


# --- projection-wide queries -------------------------------------------------------------


class AnalyticsQuery:
    """Immutable; ``using`` names the algorithm, the rest sets options."""

    def __init__(self, graph: Graph, model: AnalyticsModel) -> None:
        self.graph, self.model = graph, model

    def _with(self, **changes: Any) -> AnalyticsQuery:
        return AnalyticsQuery(self.graph, replace(self.model, **changes))

    def using(self, algorithm: str, **options: Any) -> AnalyticsQuery:
        kind = Capabilities.details(algorithm)
        if kind.family is Family.PATH:
            raise UnsupportedAnalytics(f"{algorithm} needs two ends; use shortest_path_to")
        return self._with(algorithm=algorithm, options={}).with_options(**options)

    def __getattr__(self, name: str) -> Callable[..., AnalyticsQuery]:
        if name in ALGORITHMS:
            return lambda **options: self.using(name, **options)
        raise AttributeError(name)

    def on_projection(self, name: str) -> AnalyticsQuery:
        return self._with(projection=name)

    def top(self, n: int) -> AnalyticsQuery:
        if n <= 0:
            raise ValueError("top a positive number")
        return self._with(top=n)

    def weighted_by(self, prop: str) -> AnalyticsQuery:
        numeric_property(self.graph, self.graph.model.relations[self.model.relation], prop)
        return self._with(weight=prop)

    def with_options(self, **options: Any) -> AnalyticsQuery:
        """Adds to the options."""
        kind = Capabilities.details(self.model.algorithm)
        for o in options:
            if o not in kind.options:
                raise UnsupportedAnalytics(f"{kind.name} has no option {o}")
        merged = {**self.model.options, **options}
        _check_options(kind.name, merged)
        return self._with(options=merged)

    def configure(self, algorithm: str, **options: Any) -> AnalyticsQuery:
        """Replaces the options; the algorithm must be the one in use."""
        if algorithm != self.model.algorithm:
            raise UnsupportedAnalytics(f"these are options of {algorithm}")
        return self._with(options={}).with_options(**options)

    def to_model(self) -> AnalyticsModel:
        return self.model

    def shape_key(self) -> str:
        """A digest of what is asked for, without the values of parameters."""
        m = self.model
        text = "\n".join(map(str, [m.algorithm, m.relation, m.weight, m.projection, m.top, sorted(m.options), m.nodes.node_type, m.nodes.predicate]))
        return hashlib.sha256(text.encode()).hexdigest()

    def to_df(self) -> DataFrame:
        """The node's properties, if the algorithm is about nodes, and the metrics."""
        kind = self._checked()
        rows = self._run(kind)
        m = self.model
        if kind.has_node:
            node = self.graph.model.node(m.nodes.node_type)
            table = self.graph.node_table(m.nodes.node_type)
            if m.nodes.predicate is not None:
                table = table.filter(to_column(m.nodes.predicate, lambda p: F.col(node.column(p)), m.nodes.parameters))
            metrics = [c for c in rows.columns if c != "id"]
            named = table.select(*(F.col(c).alias(p) for p, c in node.properties.items()))
            rows = named.join(rows.withColumnRenamed("id", "__id"), F.col(node.key) == F.col("__id")).select(*node.properties, *metrics)
            order = [F.col(node.key).asc()]
        else:
            order = [F.col(c).asc() for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith("array")]
        if "score" in rows.columns:
            rows = rows.orderBy(F.col("score").desc(), *order)
        elif m.top:
            rows = rows.orderBy(*order)
        return rows.limit(m.top) if m.top else rows

    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def _checked(self) -> Algorithm:
        kind = Capabilities.details(self.model.algorithm)
        if self.model.weight and not kind.weighted:
            raise UnsupportedAnalytics(f"{kind.name} takes no weights")
        for o in kind.needs:
            if o not in self.model.options:
                raise UnsupportedAnalytics(f"{kind.name} needs {o}")
        return kind

    def _projected(self) -> Projected:
        m = self.model
        if m.projection:
            if m.projection not in self.graph.projections:
                raise UnsupportedAnalytics(f"no projection {m.projection}")
            return self.graph.projections[m.projection][1]  # type: ignore[index]
        relation = self.graph.model.relations[m.relation]
        return projected(self.graph, m.relation, relation.column(m.weight) if m.weight else None)

    def _run(self, kind: Algorithm) -> DataFrame:
        """The algorithm's result as a table; what it wrote on the way is gone."""
        with scratch(self.graph.spark) as kept:
            return kept(self._raw(kind), kind.name)

    def _raw(self, kind: Algorithm) -> DataFrame:
        m = self.model
        options = dict(m.options)
        node = self.graph.model.node(m.nodes.node_type)
        table = self.graph.node_table(m.nodes.node_type)
        if kind.name in _BY_VECTOR:
            column = node.column(options.pop("node_property"))
            return kind.run(table.select(F.col(node.key_column).alias("id"), F.col(column).alias("vector")), **options)  # type: ignore[misc]
        p = self._projected()
        if kind.name in _BY_PROPERTY:
            column = node.column(options.pop("community_property"))
            return kind.run(p, table.select(F.col(node.key_column).alias("id"), F.col(column).alias("community")), **options)  # type: ignore[misc]
        if kind.name in _WEIGHT_SWITCH:
            options["weighted"] = m.weight is not None
        return kind.run(p, **options)  # type: ignore[misc]


def _check_options(name: str, options: Mapping[str, Any]) -> None:
    if name in ("pagerank", "article_rank"):
        centrality.check_rank_options(options.get("damping", centrality.DAMPING), options.get("iterations", centrality.ITERATIONS), options.get("tolerance", centrality.TOLERANCE))
    if name in ("louvain", "leiden"):
        community.check_louvain_options(options.get("levels", 10), options.get("iterations", 10), options.get("tolerance", 1e-4))


# --- routes ---------------------------------------------------------------------------


class RouteQuery:
    """Routes between two selections of nodes."""

    def __init__(self, graph: Graph, model: RouteModel) -> None:
        self.graph, self.model = graph, model

    def _with(self, **changes: Any) -> RouteQuery:
        return RouteQuery(self.graph, replace(self.model, **changes))

    def max_depth(self, n: int) -> RouteQuery:
        if n <= 0:
            raise ValueError("a depth is positive")
        return self._with(max_depth=n)

    def weighted_by(self, prop: str) -> RouteQuery:
        numeric_property(self.graph, self.graph.model.relations[self.model.relation], prop)
        return self._with(weight=prop)

    def all_shortest(self) -> RouteQuery:
        return self._with(algorithm="all_shortest_paths")

    def dijkstra(self) -> RouteQuery:
        return self._with(algorithm="dijkstra")

    def a_star(self, latitude: str, longitude: str, scale: float = 1.0) -> RouteQuery:
        """``scale`` turns kilometres into weight; it must not exceed the true cost."""
        node = self.graph.model.node(self.model.source.node_type)
        node.column(latitude), node.column(longitude)
        return self._with(algorithm="a_star", latitude=latitude, longitude=longitude, scale=scale)

    def costs_only(self) -> RouteQuery:
        """The rows without ``nodes``; paths aren't put together then (``dijkstra`` and ``a_star``)."""
        return self._with(costs_only=True)

    def yen(self, k: int) -> RouteQuery:
        if k <= 0:
            raise ValueError("k is positive")
        return self._with(algorithm="yen", k=k)

    def to_model(self) -> RouteModel:
        return self.model

    def to_df(self) -> DataFrame:
        """source, target, nodes (keys in order), hop_count, total_cost, and rank for ``yen``."""
        m = self.model
        if m.algorithm in ("dijkstra", "a_star", "yen") and m.weight is None:
            raise UnsupportedAnalytics(f"{m.algorithm} needs a weight")
        if m.algorithm == "a_star" and (m.latitude is None or m.longitude is None):
            raise UnsupportedAnalytics("a_star needs latitude and longitude")
        if m.costs_only and m.algorithm not in ("dijkstra", "a_star"):
            raise UnsupportedAnalytics(f"{m.algorithm} gives paths")
        node = self.graph.model.node(m.source.node_type)
        table = self.graph.node_table(m.source.node_type)

        def ends(model) -> DataFrame:
            own = table if model.predicate is None else table.filter(to_column(model.predicate, lambda q: F.col(node.column(q)), model.parameters))
            return own.select(F.col(node.key_column).alias("id"))

        sources, targets = ends(m.source), ends(m.target)
        with scratch(self.graph.spark) as kept:
            return kept(self._routes(m, sources, targets, node, table), m.algorithm)

    def _routes(self, m: RouteModel, sources: DataFrame, targets: DataFrame, node: NodeType, table: DataFrame) -> DataFrame:
        relation = self.graph.model.relations[m.relation]
        p = projected(self.graph, m.relation, relation.column(m.weight) if m.weight else None)
        if m.algorithm in ("shortest_path", "all_shortest_paths"):
            return paths.shortest_routes(p, sources, targets, m.max_depth, every=m.algorithm == "all_shortest_paths")
        if m.algorithm == "dijkstra":
            return paths.dijkstra(p, sources, targets, nodes=not m.costs_only)
        if m.algorithm == "yen":
            return paths.yen(p, sources, targets, m.k)
        place = table.select(F.col(node.key_column).alias("id"), F.col(node.column(m.latitude)).alias("lat"), F.col(node.column(m.longitude)).alias("lon"))
        return paths.a_star(p, sources, targets, place, m.scale, nodes=not m.costs_only)

    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def single(self) -> Row:
        found = self.to_list()
        if len(found) != 1:
            raise LookupError(f"{len(found)} routes")
        return found[0]
