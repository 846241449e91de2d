"""A unit of work: tracked changes, a plan, and an all-or-nothing save.

Changes are kept in the driver as what they are, a handful of rows.  Saving
turns them into one plan, applies it to the tables with joins, writes the
changed tables beside the old ones and then moves a manifest, so readers see
either all of it or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import GraphModel, RelationType
from graphloom.sources.files import get_text, put_text
from graphloom.sources.graph import Graph


class State(Enum):
    DETACHED = "detached"
    UNCHANGED = "unchanged"
    ADDED = "added"
    MODIFIED = "modified"
    DELETED = "deleted"


class IdentityConflict(ValueError):
    """Two tracked nodes have the same type and key."""


@dataclass
class Entry:
    """A tracked node or relation: its current values and a snapshot of the saved ones."""

    kind: str
    identity: tuple
    values: dict[str, Any]
    state: State
    snapshot: dict[str, Any] = field(default_factory=dict)
    #: Set by an explicit update: all properties are written.
    whole: bool = False
    relation: tuple[str, str, str] | None = None

    def changed(self) -> dict[str, Any]:
        if self.whole:
            return dict(self.values)
        return {k: v for k, v in self.values.items() if k not in self.snapshot or self.snapshot[k] != v}

    def is_modified(self, prop: str) -> bool:
        return prop in self.changed()


class Op(Enum):
    """In the order in which a plan applies them."""

    ADD_NODE = 0
    ADD_RELATION = 1
    MODIFY_NODE = 2
    MODIFY_RELATION = 3
    DELETE_RELATION = 4
    DELETE_NODE = 5


@dataclass(frozen=True)
class Mutation:
    op: Op
    type: str
    key: Any = None
    src: Any = None
    dst: Any = None
    edge_id: int | None = None
    values: Mapping[str, Any] = field(default_factory=dict)
    relation: tuple[str, str, str] | None = None


@dataclass(frozen=True)
class Capabilities:
    transactions: bool = False
    atomic_batch: bool = True
    scope: str = "request_or_query"
    savepoints: bool = False
    optimistic_concurrency: bool = False


class Session:
    """Tracks nodes and relations of a graph; ``save`` applies what changed."""

    capabilities = Capabilities()

    def __init__(self, graph: Graph, store: GraphStore | None = None) -> None:
        self.graph, self.store = graph, store
        self.auto_detect = True
        self._nodes: dict[tuple, Entry] = {}
        self._relations: dict[tuple, Entry] = {}

    # --- nodes -----------------------------------------------------------------

    def _track(self, label: str, values: dict[str, Any], state: State) -> Entry:
        kind = self.graph.model.node(label)
        for p in values:
            kind.column(p)
        if values.get(kind.key) is None:
            raise ValueError(f"{label} needs its key {kind.key}")
        identity = (label, values[kind.key])
        old = self._nodes.get(identity)
        if old is not None:
            if old.values is values:
                return old
            raise IdentityConflict(f"{label} {identity[1]!r} is tracked already")
        entry = Entry(label, identity, values, state, {} if state is State.ADDED else dict(values))
        self._nodes[identity] = entry
        return entry

    def add(self, label: str, values: dict[str, Any]) -> Entry:
        return self._track(label, values, State.ADDED)

    def attach(self, label: str, values: dict[str, Any]) -> Entry:
        return self._track(label, values, State.UNCHANGED)

    def update(self, label: str, values: dict[str, Any]) -> Entry:
        """Marks all properties as changed."""
        entry = self.entry(label, values) or self.attach(label, values)
        if entry.state is not State.ADDED:
            entry.state, entry.whole = State.MODIFIED, True
        return entry

    def remove(self, label: str, values: dict[str, Any]) -> None:
        """A node that was only added is forgotten."""
        entry = self.entry(label, values) or self.attach(label, values)
        if entry.state is State.ADDED:
            del self._nodes[entry.identity]
        else:
            entry.state = State.DELETED

    def entry(self, label: str, values: dict[str, Any]) -> Entry | None:
        return self._nodes.get((label, values.get(self.graph.model.node(label).key)))

    def detach(self, entry: Entry) -> None:
        for held in (self._nodes, self._relations):
            if held.get(entry.identity) is entry:
                del held[entry.identity]
        entry.state = State.DETACHED

    def reload(self, label: str, values: dict[str, Any]) -> None:
        """Read the node again by its key, which must be there once, and take its values."""
        kind = self.graph.model.node(label)
        row = self.graph.nodes(label).where(lambda p: getattr(p, kind.key) == values[kind.key]).single()
        values.update(row.asDict())
        if entry := self.entry(label, values):
            entry.snapshot, entry.state, entry.whole = dict(values), State.UNCHANGED, False

    def track_query(self, query) -> list[dict[str, Any]]:
        """Run a query and track its nodes, unless it says not to; one value for each identity."""
        label, out = query.model.result_type, []
        key = self.graph.model.node(label).key
        for row in query.to_list():
            values = row.asDict()
            if not query.model.tracking:
                out.append(values)
                continue
            old = self._nodes.get((label, values[key]))
            out.append(old.values if old else self.attach(label, values).values)
        return out

    # --- relations -------------------------------------------------------------

    def _relation_entry(self, relation: RelationType, src: Any, dst: Any, values: dict[str, Any], state: State, edge_id: int | None = None) -> Entry:
        key = (relation.source, relation.name, relation.target)
        if not relation.directed and src > dst:
            src, dst = dst, src
        identity = (key, src, dst, edge_id)
        for p in values:
            relation.column(p)
        entry = Entry(relation.name, identity, values, state, {} if state is State.ADDED else dict(values), relation=key)
        self._relations[identity] = entry
        return entry

    def connect(self, relation: RelationType, src: Any, dst: Any, values: dict[str, Any] | None = None) -> Entry:
        return self._relation_entry(relation, src, dst, values or {}, State.ADDED)

    def update_relation(self, relation: RelationType, src: Any, dst: Any, values: dict[str, Any], edge_id: int | None = None) -> Entry:
        entry = self._relation_entry(relation, src, dst, values, State.MODIFIED, edge_id)
        entry.whole = True
        return entry

    def disconnect(self, relation: RelationType, src: Any, dst: Any) -> None:
        """A relation that was only added is forgotten."""
        key = (relation.source, relation.name, relation.target)
        ends = (src, dst) if relation.directed or src <= dst else (dst, src)
        for identity, e in list(self._relations.items()):
            if identity[:3] == (key, *ends) and e.state is State.ADDED:
                del self._relations[identity]
                return
        self._relation_entry(relation, src, dst, {}, State.DELETED)

    # --- saving ----------------------------------------------------------------

    def detect_changes(self) -> None:
        for e in self._nodes.values():
            if e.state is State.UNCHANGED and e.changed():
                e.state = State.MODIFIED

    def plan(self) -> list[Mutation]:
        out = []
        for e in self._nodes.values():
            kind = self.graph.model.node(e.kind)
            if e.state is State.ADDED:
                out.append(Mutation(Op.ADD_NODE, e.kind, e.identity[1], values=dict(e.values)))
            elif e.state is State.MODIFIED:
                changed = {k: v for k, v in e.changed().items() if k != kind.key}
                out.append(Mutation(Op.MODIFY_NODE, e.kind, e.identity[1], values=changed))
            elif e.state is State.DELETED:
                out.append(Mutation(Op.DELETE_NODE, e.kind, e.identity[1]))
        ops = {State.ADDED: Op.ADD_RELATION, State.MODIFIED: Op.MODIFY_RELATION, State.DELETED: Op.DELETE_RELATION}
        for e in self._relations.values():
            if e.state in ops:
                _, src, dst, edge_id = e.identity
                out.append(Mutation(ops[e.state], e.kind, src=src, dst=dst, edge_id=edge_id, values=e.changed(), relation=e.relation))
        return sorted(out, key=lambda m: m.op.value)

    def save(self) -> int:
        """The number of operations.  If saving fails, everything stays pending."""
        if self.auto_detect:
            self.detect_changes()
        todo = self.plan()
        if not todo:
            return 0
        if self.store is None:
            raise ValueError("the session has no store to save to")
        self.graph = self.store.commit(apply_plan(self.graph, todo))
        self._accept()
        return len(todo)

    def _accept(self) -> None:
        for held in (self._nodes, self._relations):
            for identity, e in list(held.items()):
                if e.state is State.DELETED:
                    del held[identity]
                    e.state = State.DETACHED
                else:
                    e.state, e.snapshot, e.whole = State.UNCHANGED, dict(e.values), False


# --- applying -----------------------------------------------------------------------


def apply_plan(graph: Graph, plan: Iterable[Mutation]) -> Graph:
    """The graph after a plan, in the order of its operations.

    Adding a node is an upsert by key, adding a relation merges with one of the
    same ends, modifying what isn't there does nothing, and deleting a node
    takes its relations with it.  Only changed tables get a new plan.
    """
    todo = sorted(plan, key=lambda m: m.op.value)
    nodes, edges = dict(graph.node_tables), dict(graph.edge_tables)
    for op in Op:
        groups: dict[Any, list[Mutation]] = {}
        for m in todo:
            if m.op is op:
                groups.setdefault(m.relation or m.type, []).append(m)
        for name, own in groups.items():
            if op in (Op.ADD_NODE, Op.MODIFY_NODE):
                nodes[name] = _write_nodes(graph, name, nodes[name], own, insert=op is Op.ADD_NODE)
            elif op is Op.DELETE_NODE:
                _delete_nodes(graph, name, own, nodes, edges)
            elif op is Op.DELETE_RELATION:
                edges[name] = _delete_edges(graph, name, edges[name], own)
            else:
                edges[name] = _write_edges(graph, name, edges[name], own, insert=op is Op.ADD_RELATION)
    return Graph(graph.spark, graph.model, nodes, edges)


def _changes(spark: SparkSession, table: DataFrame, keys: list[str], rows: list[tuple[dict, dict]]) -> DataFrame:
    """key columns, a new value and whether there is one for each other column; the last row of a key wins."""
    others = [f for f in table.schema if f.name not in keys]
    merged: dict[tuple, tuple[dict, dict]] = {}
    for key, values in rows:
        at = tuple(key.values())
        merged[at] = (key, {**merged.get(at, ({}, {}))[1], **values})
    schema = ", ".join([f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys] + [f"`n_{f.name}` {f.dataType.simpleString()}, `h_{f.name}` boolean" for f in others])
    data = [(*key.values(), *(x for f in others for x in (values.get(f.name), f.name in values))) for key, values in merged.values()]
    return spark.createDataFrame(data, schema)


#: Rows of a plan that are broadcast; more are joined like any table.
MOST_BROADCAST = 100_000


def _few(rows: list, table: DataFrame) -> DataFrame:
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def _merged(table: DataFrame, changes: DataFrame, keys: list[str], insert: bool) -> DataFrame:
    joined = table.alias("t").join(changes, keys, "full_outer" if insert else "left")
    columns = []
    for f in table.schema:
        if f.name in keys:
            columns.append(F.col(f.name))
        else:
            columns.append(F.when(F.col(f"h_{f.name}"), F.col(f"n_{f.name}")).otherwise(F.col(f.name)).alias(f.name))
    return joined.select(*columns)


def _write_nodes(graph: Graph, label: str, table: DataFrame, own: list[Mutation], insert: bool) -> DataFrame:
    kind = graph.model.node(label)
    rows = [({kind.key_column: m.key}, {kind.column(p): v for p, v in m.values.items() if p != kind.key}) for m in own]
    changes = _changes(graph.spark, table, [kind.key_column], rows)
    return _merged(table, changes if insert else _few(rows, changes), [kind.key_column], insert)


def _write_edges(graph: Graph, key: tuple[str, str, str], table: DataFrame, own: list[Mutation], insert: bool) -> DataFrame:
    kind = graph.model.relations[key]
    if not insert:
        for by_id in (True, False):
            part = [m for m in own if (m.edge_id is not None) == by_id]
            if part:
                keys = ["edge_id"] if by_id else ["src", "dst"]
                rows = [({"edge_id": m.edge_id} if by_id else {"src": m.src, "dst": m.dst}, {kind.column(p): v for p, v in m.values.items()}) for m in part]
                table = _merged(table, _few(rows, _changes(graph.spark, table, keys, rows)), keys, insert=False)
        return table
    rows = [({"src": m.src, "dst": m.dst}, {kind.column(p): v for p, v in m.values.items()}) for m in own]
    changes = _changes(graph.spark, table, ["src", "dst"], rows)
    merged = _merged(table, changes, ["src", "dst"], insert=True)
    return merged.withColumn("edge_id", F.coalesce("edge_id", F.xxhash64("src", "dst", F.lit("merged")))).select(*table.columns)


def _delete_edges(graph: Graph, key: tuple[str, str, str], table: DataFrame, own: list[Mutation]) -> DataFrame:
    kind = graph.model.relations[key]
    ends = [(m.src, m.dst) for m in own] + ([] if kind.directed else [(m.dst, m.src) for m in own])
    schema = f"src {table.schema['src'].dataType.simpleString()}, dst {table.schema['dst'].dataType.simpleString()}"
    return table.join(_few(ends, graph.spark.createDataFrame(ends, schema)), ["src", "dst"], "left_anti").select(*table.columns)


def _delete_nodes(graph: Graph, label: str, own: list[Mutation], nodes: dict, edges: dict) -> None:
    kind = graph.model.node(label)
    column = kind.key_column
    gone = _few(own, graph.spark.createDataFrame([(m.key,) for m in own], f"`{column}` {nodes[label].schema[column].dataType.simpleString()}"))
    nodes[label] = nodes[label].join(gone, column, "left_anti").select(*nodes[label].columns)
    for key, table in edges.items():
        for end, side in ((key[0], "src"), (key[2], "dst")):
            if end == label:
                edges[key] = table = table.join(gone.withColumnRenamed(column, side), side, "left_anti").select(*table.columns)


# --- storing ------------------------------------------------------------------------


class GraphStore:
    """Tables as Parquet below a folder, and a manifest that names the current ones.

    A commit writes only tables that changed, in new folders, and then replaces
    the manifest by a rename.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, model: GraphModel) -> None:
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def _manifest(self) -> dict[str, str]:
        text = get_text(self.spark, f"{self.path}/manifest.json")
        return {} if text is None else json.loads(text)

    @staticmethod
    def _name(key: str | tuple[str, str, str]) -> str:
        return key if isinstance(key, str) else "-".join(key)

    def create(self, graph: Graph) -> Graph:
        self._current: dict[str, DataFrame] = {}
        return self.commit(graph)

    def open(self) -> Graph:
        held = self._manifest()
        self._current = {name: self.spark.read.parquet(path) for name, path in held.items()}
        return self._graph()

    def _graph(self) -> Graph:
        return Graph(
            self.spark,
            self.model,
            {n: self._current[n] for n in self.model.nodes},
            {k: self._current[self._name(k)] for k in self.model.relations},
        )

    def commit(self, graph: Graph) -> Graph:
        held = self._manifest()
        tables = {self._name(k): t for k, t in [*graph.node_tables.items(), *graph.edge_tables.items()]}
        for name, table in tables.items():
            if self._current.get(name) is table:
                continue
            place = f"{self.path}/{name}-{uuid.uuid4().hex}"
            table.write.parquet(place)
            held[name] = place
        self._swap(held)
        self._current = {name: tables[name] if self._current.get(name) is tables[name] else self.spark.read.parquet(held[name]) for name in tables}
        return self._graph()

    def _swap(self, held: dict[str, str]) -> None:
        put_text(self.spark, f"{self.path}/manifest.json", json.dumps(held, sort_keys=True))
