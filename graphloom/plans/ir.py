"""Immutable descriptions of queries, independent of how they are run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from graphloom.functions.predicates import Predicate

ROOT = "node"


class Direction(Enum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    UNDIRECTED = "undirected"


class Projection(Enum):
    NODE = "node"
    PATH = "path"
    SUBGRAPH = "subgraph"
    COUNT = "count"


class CyclePolicy(Enum):
    #: No edge twice within one pattern.
    DEFAULT = "default"
    #: No node twice on a path.
    SIMPLE_PATH = "simple_path"


@dataclass(frozen=True)
class Ordering:
    alias: str
    prop: str
    descending: bool = False


@dataclass(frozen=True)
class Step:
    """One traversal; several relation types are alternatives."""

    relations: tuple[tuple[str, str, str], ...]
    source_alias: str
    relation_alias: str
    target_alias: str
    source_type: str
    target_type: str
    direction: Direction
    min_depth: int = 1
    max_depth: int = 1
    optional: bool = False
    predicate: Predicate | None = None
    relation_predicate: Predicate | None = None

    @property
    def single_hop(self) -> bool:
        return self.min_depth == self.max_depth == 1


@dataclass(frozen=True)
class QueryModel:
    node_type: str
    predicate: Predicate | None = None
    parameters: Mapping[str, Any] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()
    orderings: tuple[Ordering, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    projection: Projection = Projection.NODE
    cycles: CyclePolicy = CyclePolicy.DEFAULT
    tracking: bool = True

    @property
    def result_alias(self) -> str:
        return self.steps[-1].target_alias if self.steps else ROOT

    @property
    def result_type(self) -> str:
        return self.steps[-1].target_type if self.steps else self.node_type


@dataclass(frozen=True)
class AnalyticsModel:
    nodes: QueryModel
    relation: tuple[str, str, str]
    algorithm: str
    weight: str | None = None
    projection: str | None = None
    top: int | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RouteModel:
    source: QueryModel
    target: QueryModel
    relation: tuple[str, str, str]
    algorithm: str = "shortest_path"
    max_depth: int | None = None
    weight: str | None = None
    k: int = 1
    latitude: str | None = None
    longitude: str | None = None
    scale: float = 1.0
    costs_only: bool = False
