"""From a query description to a DataFrame.

Every traversal step is an equi-join of the frontier with a relation table and
then with the target's node table; Catalyst and adaptive execution choose how.
Columns of an alias are named ``alias__column`` until the result is projected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import Predicate, to_column
from graphloom.plans.ir import ROOT, CyclePolicy, Direction, Projection, QueryModel, Step
from graphloom.plans.lineage import written
from graphloom.sources.graph import Graph


class UnsupportedQuery(ValueError):
    """A combination that has no meaning; raised before anything runs."""


def check(model: QueryModel) -> None:
    optional = any(s.optional for s in model.steps)
    if optional and model.cycles is CyclePolicy.SIMPLE_PATH:
        raise UnsupportedQuery("an optional traversal can't be part of a simple path")
    if model.projection is Projection.PATH and (not model.steps or not model.steps[-1].single_hop):
        raise UnsupportedQuery("a path ends in a traversal of one hop")
    if model.distinct and any(o.alias != model.result_alias for o in model.orderings):
        raise UnsupportedQuery("distinct results can be ordered by their own properties only")


# --- scans ----------------------------------------------------------------------


def _scan(graph: Graph, label: str, alias: str, predicate: Predicate | None, values: Mapping[str, Any]) -> DataFrame:
    kind = graph.model.node(label)
    table = graph.node_table(label)
    if predicate is not None:
        table = table.filter(to_column(predicate, lambda p: F.col(kind.column(p)), values))
    return table.select(*(F.col(c).alias(f"{alias}__{c}") for c in kind.properties.values()))


def _edges(graph: Graph, step: Step, values: Mapping[str, Any]) -> DataFrame:
    """from_key, to_key, from_label, to_label, relation, edge_id, ends as declared, and payload columns."""
    out = []
    for key in step.relations:
        kind = graph.model.relations[key]
        table = graph.edge_table(key)
        if step.relation_predicate is not None:
            table = table.filter(to_column(step.relation_predicate, lambda p, kind=kind: F.col(kind.column(p)), values))
        payload = [F.col(c) for c in kind.properties.values()]
        common = [F.lit(kind.name).alias("relation"), "edge_id", F.col("src").alias("source_id"), F.col("dst").alias("target_id")]
        ahead = table.select(
            F.col("src").alias("from_key"), F.col("dst").alias("to_key"), F.lit(kind.source).alias("from_label"), F.lit(kind.target).alias("to_label"), *common, *payload
        )
        back = table.select(
            F.col("dst").alias("from_key"), F.col("src").alias("to_key"), F.lit(kind.target).alias("from_label"), F.lit(kind.source).alias("to_label"), *common, *payload
        )
        if step.direction is Direction.OUTGOING:
            out.append(ahead)
        elif step.direction is Direction.INCOMING:
            out.append(back)
        else:  # a self-loop is met once
            out += [ahead, back.filter("source_id <> target_id") if kind.source == kind.target else back]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


EDGE_KEEP = ("relation", "edge_id", "source_id", "target_id")


# --- steps ----------------------------------------------------------------------


def rows(model: QueryModel, graph: Graph) -> DataFrame:
    """One row for each match of the pattern, with the columns of all aliases."""
    check(model)
    values = model.parameters
    frontier = _scan(graph, model.node_type, ROOT, model.predicate, values)
    optional = any(s.optional for s in model.steps)
    simple = model.cycles is CyclePolicy.SIMPLE_PATH
    # Edges already used matter where a relation can be met again in the same pattern.
    met: set[tuple[str, str, str]] = set()
    again = False
    for s in model.steps:
        again |= not s.single_hop or bool(met & set(s.relations))
        met |= set(s.relations)
    track_edges = again and not optional and not simple
    if model.steps and simple:
        frontier = frontier.withColumn("__seen", F.array(_node_id(F.lit(model.node_type), _key(graph, model.node_type, ROOT))))
    if model.steps and track_edges:
        frontier = frontier.withColumn("__used", F.array().cast("array<struct<relation:string,edge_id:bigint>>"))
    for s in model.steps:
        if s.single_hop:
            frontier = _hop(frontier, graph, s, values, simple, track_edges)
        else:
            frontier = _var_hops(frontier, graph, s, values, simple, track_edges)
    return frontier


def _key_name(graph: Graph, label: str, alias: str) -> str:
    return f"{alias}__{graph.model.node(label).key_column}"


def _key(graph: Graph, label: str, alias: str) -> Column:
    return F.col(_key_name(graph, label, alias))


def _node_id(label: Column, key: Column) -> Column:
    return F.struct(label.alias("label"), key.cast("string").alias("key"))


def _used(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}relation").alias("relation"), F.col(f"{prefix}edge_id").alias("edge_id"))


def _hop(frontier: DataFrame, graph: Graph, s: Step, values: Mapping[str, Any], simple: bool, track: bool) -> DataFrame:
    edges = _edges(graph, s, values).filter((F.col("from_label") == s.source_type) & (F.col("to_label") == s.target_type))
    r = s.relation_alias
    payload = [c for c in edges.columns if c not in ("from_key", "to_key", "from_label", "to_label")]
    edges = edges.select(F.col("from_key").alias("__from"), F.col("to_key").alias("__to"), *(F.col(c).alias(f"{r}__{c}") for c in payload))
    target = _scan(graph, s.target_type, s.target_alias, s.predicate, values)
    target_key = _key(graph, s.target_type, s.target_alias)
    source_key = _key(graph, s.source_type, s.source_alias)
    if s.optional:
        # The predicates belong to the optional side, before the outer join.
        side = edges.join(target, edges["__to"] == target_key)
        return frontier.join(side, source_key == side["__from"], "left_outer").drop("__from", "__to")
    out = frontier.join(edges, source_key == edges["__from"])
    if track:
        out = out.filter(~F.array_contains("__used", _used(f"{r}__")))
        out = out.withColumn("__used", F.concat("__used", F.array(_used(f"{r}__"))))
    if simple:
        reached = _node_id(F.lit(s.target_type), F.col("__to"))
        out = out.filter(~F.array_contains("__seen", reached)).withColumn("__seen", F.concat("__seen", F.array(reached)))
    return out.join(target, out["__to"] == target_key).drop("__from", "__to")


def _var_hops(frontier: DataFrame, graph: Graph, s: Step, values: Mapping[str, Any], simple: bool, track: bool) -> DataFrame:
    """min..max hops as a union of joins, one for each depth.

    A path ends early where its label has no such relation.  The edges met are
    an array under the relation's alias.
    """
    r = s.relation_alias
    carry = list(frontier.columns)
    state = (
        frontier.withColumn("__at", _key(graph, s.source_type, s.source_alias))
        .withColumn("__label", F.lit(s.source_type))
        .withColumn(f"{r}__edges", F.array().cast("array<struct<relation:string,edge_id:bigint,source_id:string,target_id:string>>"))
    )
    # An edge is not used twice in a pattern even where nothing else asks for it.
    own_use = not simple and not track
    if own_use:
        state = state.withColumn("__own", F.array().cast("array<struct<relation:string,edge_id:bigint>>"))
    edges = _edges(graph, s, values).select("from_key", "to_key", "from_label", "to_label", *EDGE_KEEP)
    labels = {(k[0], k[2]) for k in s.relations} | ({(k[2], k[0]) for k in s.relations})
    found = []
    reach = {s.source_type}
    for depth in range(s.max_depth + 1):
        if depth >= s.min_depth and s.target_type in reach:
            found.append(state.filter(F.col("__label") == s.target_type))
        if depth == s.max_depth:
            break
        reach = {b for a, b in labels if a in reach}
        state = state.join(edges, (F.col("__at") == F.col("from_key")) & (F.col("__label") == F.col("from_label")))
        if track or own_use:
            held = "__used" if track else "__own"
            state = state.filter(~F.array_contains(held, _used())).withColumn(held, F.concat(held, F.array(_used())))
        if simple:
            node = _node_id(F.col("to_label"), F.col("to_key"))
            state = state.filter(~F.array_contains("__seen", node)).withColumn("__seen", F.concat("__seen", F.array(node)))
        met = F.struct(
            F.col("relation"), F.col("edge_id"), F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id")
        )
        state = state.withColumn(f"{r}__edges", F.concat(f"{r}__edges", F.array(met))).withColumn("__at", F.col("to_key")).withColumn("__label", F.col("to_label"))
        state = state.select(*carry, "__at", "__label", f"{r}__edges", *(["__own"] if own_use else []))
    target = _scan(graph, s.target_type, s.target_alias, s.predicate, values)
    if not found:
        found = [state.filter(F.lit(False))]
    ends = reduce(DataFrame.unionByName, found).select(*carry, "__at", f"{r}__edges")
    if s.optional:
        start = _key(graph, s.source_type, s.source_alias)
        side = ends.join(target, ends["__at"] == _key(graph, s.target_type, s.target_alias)).drop("__at")
        own = [c for c in side.columns if c not in carry]
        named = side.select(start.alias("__from"), *own).distinct()
        return frontier.join(named, start == named["__from"], "left_outer").drop("__from")
    return ends.join(target, ends["__at"] == _key(graph, s.target_type, s.target_alias)).drop("__at")


# --- reach without paths -----------------------------------------------------------


def _frontier_only(model: QueryModel) -> bool:
    """Whether distinct targets of one directed variable-depth step are asked for.

    Walks then reach the same nodes as paths that use no edge twice, so the
    frontier can be reduced to distinct keys after every hop.
    """
    if len(model.steps) != 1 or model.cycles is not CyclePolicy.DEFAULT or not model.distinct:
        return False
    s = model.steps[0]
    return (
        not s.single_hop and not s.optional and s.min_depth <= 1 and s.direction is not Direction.UNDIRECTED and model.projection in (Projection.NODE, Projection.COUNT)
        and not any(o.alias != s.target_alias for o in model.orderings)
    )


def _reached(model: QueryModel, graph: Graph) -> DataFrame:
    (s,) = model.steps
    values = model.parameters
    edges = _edges(graph, s, values).select("from_key", "to_key", "from_label", "to_label").distinct()
    start = _scan(graph, model.node_type, ROOT, model.predicate, values)
    # Each hop's new nodes are a table; a node that was met before leads nowhere new.
    now = written(start.select(_key(graph, model.node_type, ROOT).alias("key"), F.lit(s.source_type).alias("label")).distinct(), "frontier")
    met, hops = [now], []
    for _ in range(s.max_depth):
        ahead = (
            now.join(edges, (now["key"] == edges["from_key"]) & (now["label"] == edges["from_label"]))
            .select(F.col("to_key").alias("key"), F.col("to_label").alias("label"))
            .distinct()
        )
        hops.append(written(ahead, "reached"))
        now = written(hops[-1].join(reduce(DataFrame.union, met), ["key", "label"], "left_anti"), "frontier")
        if now.isEmpty():
            break
        met.append(now)
    found = [met[0], *hops] if s.min_depth == 0 else hops
    keys = reduce(DataFrame.union, found).filter(F.col("label") == s.target_type).select("key").distinct()
    target = _scan(graph, s.target_type, s.target_alias, s.predicate, values)
    return target.join(keys, _key(graph, s.target_type, s.target_alias) == keys["key"], "left_semi")


# --- results --------------------------------------------------------------------


def _ordered(df: DataFrame, model: QueryModel, graph: Graph) -> DataFrame:
    """Ascending puts nulls last, descending first."""
    if not model.orderings:
        return df
    columns = []
    types = {ROOT: model.node_type} | {s.target_alias: s.target_type for s in model.steps}
    for o in model.orderings:
        c = F.col(f"{o.alias}__{graph.model.node(types[o.alias]).column(o.prop)}")
        columns.append(c.desc_nulls_first() if o.descending else c.asc_nulls_last())
    return df.orderBy(*columns)


def _paged(df: DataFrame, model: QueryModel) -> DataFrame:
    if model.offset:
        df = df.offset(model.offset)
    return df if model.limit is None else df.limit(model.limit)


def _matches(model: QueryModel, graph: Graph) -> DataFrame:
    """Rows whose result node is there, distinct if asked for, ordered and paged."""
    key = _key(graph, model.result_type, model.result_alias)
    if _frontier_only(model):
        df = _reached(model, graph)
    else:
        df = rows(model, graph)
        if any(s.optional for s in model.steps) and model.projection is not Projection.SUBGRAPH:
            df = df.filter(key.isNotNull())
        if model.distinct:
            own = [_key_name(graph, model.result_type, model.result_alias)]
            df = df.dropDuplicates(own if model.projection is not Projection.PATH else _path_names(model, graph))
    return _paged(_ordered(df, model, graph), model)


def _path_names(model: QueryModel, graph: Graph) -> list[str]:
    s = model.steps[-1]
    return [_key_name(graph, s.source_type, s.source_alias), f"{s.relation_alias}__edge_id", _key_name(graph, s.target_type, s.target_alias)]


def node_result(model: QueryModel, graph: Graph) -> DataFrame:
    """The result nodes, with their property names."""
    kind = graph.model.node(model.result_type)
    df = _matches(model, graph)
    return df.select(*(F.col(f"{model.result_alias}__{c}").alias(p) for p, c in kind.properties.items()))


def path_result(model: QueryModel, graph: Graph) -> DataFrame:
    """source, relation and target of the last hop, as structs."""
    s = model.steps[-1]
    df = _matches(model, graph)

    def node(label: str, alias: str) -> Column:
        return F.struct(*(F.col(f"{alias}__{c}").alias(p) for p, c in graph.model.node(label).properties.items()))

    own = [c for c in df.columns if c.startswith(f"{s.relation_alias}__")]
    names = {c: p for k in s.relations for p, c in graph.model.relations[k].properties.items()}
    relation = F.struct(*(F.col(c).alias(names.get(c.split("__", 1)[1], c.split("__", 1)[1])) for c in own))
    return df.select(
        node(s.source_type, s.source_alias).alias("source"), relation.alias("relation"), node(s.target_type, s.target_alias).alias("target")
    )


def count_result(model: QueryModel, graph: Graph) -> DataFrame:
    """One row, ``n``: the number of matches, or of distinct result nodes.

    Orderings don't matter and are left out; with paging the page is counted.
    """
    if model.limit is None and not model.offset:
        model = replace(model, orderings=())
    return _matches(model, graph).agg(F.count("*").alias("n"))


def subgraph_result(model: QueryModel, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(label, id, properties as JSON) and (relation, edge_id, source_id, target_id, properties as JSON), each once."""
    df = _matches(model, graph)
    nodes, edges = [], []
    aliases = [(ROOT, model.node_type)] + [(s.target_alias, s.target_type) for s in model.steps]
    for alias, label in aliases:
        kind = graph.model.node(label)
        fields = F.struct(*(F.col(f"{alias}__{c}").alias(p) for p, c in kind.properties.items()))
        key = _key(graph, label, alias)
        nodes.append(df.filter(key.isNotNull()).select(F.lit(label).alias("label"), key.cast("string").alias("id"), F.to_json(fields).alias("properties")))
    for s in model.steps:
        r = s.relation_alias
        if s.single_hop:
            own = df.filter(F.col(f"{r}__edge_id").isNotNull())
            edges.append(own.select(F.col(f"{r}__relation").alias("relation"), F.col(f"{r}__edge_id").alias("edge_id"),
                                    F.col(f"{r}__source_id").cast("string").alias("source_id"), F.col(f"{r}__target_id").cast("string").alias("target_id")))
        else:
            edges.append(df.select(F.explode(f"{r}__edges").alias("e")).select("e.relation", "e.edge_id", "e.source_id", "e.target_id"))
    all_nodes = reduce(DataFrame.union, nodes).dropDuplicates(["label", "id"])
    if not edges:
        empty = graph.spark.createDataFrame([], "relation string, edge_id long, source_id string, target_id string, properties string")
        return all_nodes, empty
    once = reduce(DataFrame.union, edges).dropDuplicates(["relation", "edge_id"])
    # The payload is fetched once for each edge, not carried through the match.
    payload = reduce(DataFrame.union, [_payload(graph, k) for k in {k for s in model.steps for k in s.relations}])
    own = payload.select(F.col("relation").alias("r"), F.col("edge_id").alias("e"), "properties")
    found = once.join(own, (F.col("relation") == F.col("r")) & (F.col("edge_id") == F.col("e")), "left")
    return all_nodes, found.select("relation", "edge_id", "source_id", "target_id", F.coalesce("properties", F.lit("{}")).alias("properties"))


def _payload(graph: Graph, key: tuple[str, str, str]) -> DataFrame:
    """relation, edge_id, properties of all edges of a relation."""
    kind = graph.model.relations[key]
    fields = [F.col(c).alias(p) for p, c in kind.properties.items() if c not in ("src", "dst", "edge_id")]
    text = F.to_json(F.struct(*fields)) if fields else F.lit("{}")
    return graph.edge_table(kind).select(F.lit(kind.name).alias("relation"), "edge_id", text.alias("properties"))
