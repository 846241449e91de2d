"""The fluent, immutable query builder.

Calls set parts of a description and don't run anything; they are flags, not a
pipeline: ``take(5).where(p)`` filters first and takes then.  Terminals compile
the description to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Row

from graphloom.functions.predicates import Parameters, all_of, rename, translate
from graphloom.model import RelationType
from graphloom.plans import compiler
from graphloom.plans.ir import ROOT, AnalyticsModel, CyclePolicy, Direction, Ordering, Projection, QueryModel, RouteModel, Step
from graphloom.sources.graph import Graph


class Empty(LookupError):
    """A result was asked for and there is none."""


class NotSingle(LookupError):
    """One result was asked for and there are more."""


def _relation_key(r: RelationType) -> tuple[str, str, str]:
    return (r.source, r.name, r.target)


class Query:
    def __init__(self, graph: Graph, model: QueryModel, selected: tuple[str, ...] | None = None) -> None:
        self.graph, self.model, self._selected = graph, model, selected

    @classmethod
    def root(cls, graph: Graph, label: str) -> Query:
        return cls(graph, QueryModel(label))

    def _with(self, **changes: Any) -> Query:
        return Query(self.graph, replace(self.model, **changes), self._selected)

    def _type(self):
        return self.graph.model.node(self.model.result_type)

    # --- filters ---------------------------------------------------------------

    def where(self, predicate: Callable[[Any], object]) -> Query:
        """Filters the last traversal's target, or the root if there is none; calls add up."""
        parameters = Parameters(self.model.parameters)
        tree = translate(self._type(), predicate, parameters)
        if self.model.steps:
            *before, last = self.model.steps
            steps = (*before, replace(last, predicate=all_of(last.predicate, tree)))
            return self._with(steps=steps, parameters=parameters.values)
        return self._with(predicate=all_of(self.model.predicate, tree), parameters=parameters.values)

    match = where

    # --- traversals ------------------------------------------------------------

    def _append(self, relations: tuple[RelationType, ...], target: str, direction: Direction, low: int = 1, high: int = 1, optional: bool = False) -> Query:
        if low < 0:
            raise ValueError("the least depth is 0")
        if high < low:
            raise ValueError("the greatest depth is below the least")
        n = len(self.model.steps) + 1
        step = Step(
            tuple(_relation_key(r) for r in relations), self.model.result_alias, f"relation{n}", f"node{n}", self.model.result_type, target, direction, low, high, optional
        )
        return self._with(steps=(*self.model.steps, step))

    def _starts_here(self, relation: RelationType) -> None:
        here = self.model.result_type
        if relation.source != here and (relation.directed or relation.target != here):
            raise ValueError(f"{relation.name} doesn't start from {here}")

    def _direction(self, relation: RelationType) -> Direction:
        return Direction.OUTGOING if relation.directed else Direction.UNDIRECTED

    def traverse(self, relation: RelationType, min_depth: int = 1, max_depth: int = 1) -> Query:
        self._starts_here(relation)
        return self._append((relation,), relation.target, self._direction(relation), min_depth, max_depth)

    def traverse_optional(self, relation: RelationType) -> Query:
        self._starts_here(relation)
        return self._append((relation,), relation.target, self._direction(relation), optional=True)

    def traverse_any(self, *relations: RelationType) -> Query:
        if not relations:
            raise ValueError("at least one relation is needed")
        first = relations[0]
        for r in relations:
            self._starts_here(r)
            if r.target != first.target or r.directed != first.directed:
                raise ValueError("the relations must have the same target type and direction")
        return self._append(relations, first.target, self._direction(first))

    def traverse_incoming(self, relation: RelationType) -> Query:
        if relation.target != self.model.result_type:
            raise ValueError(f"{relation.name} doesn't lead to {self.model.result_type}")
        return self._append((relation,), relation.source, Direction.INCOMING)

    def traverse_path(self, relation: RelationType) -> PathQuery:
        self._starts_here(relation)
        inner = self._append((relation,), relation.target, self._direction(relation))
        return PathQuery(inner._with(projection=Projection.PATH), relation)

    def without_cycles(self) -> Query:
        return self._with(cycles=CyclePolicy.SIMPLE_PATH)

    # --- shape -----------------------------------------------------------------

    def take(self, n: int) -> Query:
        if n <= 0:
            raise ValueError("take a positive number")
        return self._with(limit=n)

    def skip(self, n: int) -> Query:
        if n < 0:
            raise ValueError("skip 0 or more")
        return self._with(offset=n)

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def order_by(self, prop: str, descending: bool = False) -> Query:
        self._type().column(prop)
        return self._with(orderings=(Ordering(self.model.result_alias, prop, descending),))

    def then_by(self, prop: str, descending: bool = False) -> Query:
        if not self.model.orderings:
            raise ValueError("then_by follows order_by")
        self._type().column(prop)
        return self._with(orderings=(*self.model.orderings, Ordering(self.model.result_alias, prop, descending)))

    def select(self, *props: str) -> Query:
        """Only these properties; columns that nothing needs aren't read."""
        for p in props:
            self._type().column(p)
        return Query(self.graph, self.model, props)

    def as_no_tracking(self) -> Query:
        return self._with(tracking=False)

    # --- terminals -------------------------------------------------------------

    def to_model(self) -> QueryModel:
        return self.model

    def to_df(self) -> DataFrame:
        found = compiler.node_result(self.model, self.graph)
        return found.select(*self._selected) if self._selected else found

    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def iterate(self) -> Iterator[Row]:
        """Rows one partition at a time; the driver never holds them all."""
        return self.to_df().toLocalIterator()

    def first(self) -> Row:
        found = self.first_or_none()
        if found is None:
            raise Empty("no result")
        return found

    def first_or_none(self) -> Row | None:
        return next(iter(Query(self.graph, replace(self.model, limit=1), self._selected).to_list()), None)

    def single(self) -> Row:
        found = self.single_or_none()
        if found is None:
            raise Empty("no result")
        return found

    def single_or_none(self) -> Row | None:
        found = Query(self.graph, replace(self.model, limit=2), self._selected).to_list()
        if len(found) > 1:
            raise NotSingle("more than one result")
        return found[0] if found else None

    def any(self) -> bool:
        return self.first_or_none() is not None

    def count_df(self) -> DataFrame:
        return compiler.count_result(replace(self.model, projection=Projection.COUNT), self.graph)

    def count(self) -> int:
        return self.count_df().first().n

    def to_subgraph(self) -> tuple[DataFrame, DataFrame]:
        """The nodes and the edges of all matches, each once."""
        return compiler.subgraph_result(replace(self.model, projection=Projection.SUBGRAPH), self.graph)

    # --- analytics -------------------------------------------------------------

    def analyze(self, relation: RelationType):
        """Algorithms over a relation of this node type with itself."""
        from graphloom.plans.analytics import AnalyticsQuery

        if not relation.source == relation.target == self.model.node_type:
            raise ValueError("analytics need a relation of the node type with itself")
        return AnalyticsQuery(self.graph, AnalyticsModel(self.model, _relation_key(relation), ""))

    def shortest_path_to(self, target: Query, relation: RelationType):
        """Routes from these nodes to those; ends are selections without traversals."""
        from graphloom.plans.analytics import RouteQuery

        if self.model.steps or target.model.steps:
            raise ValueError("the ends of a route are selections without traversals")
        if not relation.source == relation.target == self.model.node_type == target.model.node_type:
            raise ValueError("routes need a relation of the node type with itself")
        shift = len(self.model.parameters)
        names = {old: f"p{int(old[1:]) + shift}" for old in target.model.parameters}
        moved = replace(
            target.model, predicate=rename(target.model.predicate, names), parameters={names[k]: v for k, v in target.model.parameters.items()}
        )
        return RouteQuery(self.graph, RouteModel(self.model, moved, _relation_key(relation)))


class PathQuery:
    """The paths of one hop: source, relation and target."""

    def __init__(self, inner: Query, relation: RelationType) -> None:
        self._inner, self._relation = inner, relation

    def where_relation(self, predicate: Callable[[Any], object]) -> PathQuery:
        parameters = Parameters(self._inner.model.parameters)
        tree = translate(self._relation, predicate, parameters)
        *before, last = self._inner.model.steps
        steps = (*before, replace(last, relation_predicate=all_of(last.relation_predicate, tree)))
        return PathQuery(self._inner._with(steps=steps, parameters=parameters.values), self._relation)

    def where_target(self, predicate: Callable[[Any], object]) -> PathQuery:
        return PathQuery(self._inner.where(predicate), self._relation)

    def distinct(self) -> PathQuery:
        return PathQuery(self._inner.distinct(), self._relation)

    def take(self, n: int) -> PathQuery:
        return PathQuery(self._inner.take(n), self._relation)

    def to_model(self) -> QueryModel:
        return self._inner.model

    def to_df(self) -> DataFrame:
        return compiler.path_result(self._inner.model, self._inner.graph)

    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def relations_df(self) -> DataFrame:
        return self.to_df().select("relation.*")

    def to_relations(self) -> list[Row]:
        return self.relations_df().collect()

    def single(self) -> Row:
        found = self.to_list()
        if not found:
            raise Empty("no path")
        if len(found) > 1:
            raise NotSingle("more than one path")
        return found[0]


def compiled(make: Callable[..., Query]) -> Callable[..., DataFrame]:
    """A query with parameters as a function that returns its DataFrame."""

    def call(*values: Any) -> DataFrame:
        return make(*values).to_df()

    return call


__all__ = ["ROOT", "Empty", "NotSingle", "PathQuery", "Query", "compiled"]
