"""Checksummed schema migrations over a registry of declared types."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from copy import deepcopy
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import get_text, put_text


class MigrationError(ValueError):
    """A plan that can't be made or a step that can't be undone."""


@dataclass(frozen=True)
class Command:
    """One step as text; ``kind`` and ``transactional`` are part of the checksum."""

    kind: str
    text: str
    transactional: bool = True


class MigrationBuilder:
    """Collects operations in order."""

    def __init__(self) -> None:
        self.commands: list[Command] = []

    def _add(self, kind: str, **what: Any) -> MigrationBuilder:
        self.commands.append(Command(kind, json.dumps(what, sort_keys=True)))
        return self

    def create_node_type(self, name: str, key: str, properties: dict[str, str]) -> MigrationBuilder:
        return self._add("create_node_type", name=name, key=key, properties=properties)

    def drop_node_type(self, name: str) -> MigrationBuilder:
        return self._add("drop_node_type", name=name)

    def create_relation_type(self, name: str, source: str, target: str, directed: bool = True, properties: dict[str, str] | None = None) -> MigrationBuilder:
        return self._add("create_relation_type", name=name, source=source, target=target, directed=directed, properties=properties or {})

    def drop_relation_type(self, name: str) -> MigrationBuilder:
        return self._add("drop_relation_type", name=name)

    def unique_constraint(self, name: str, node_type: str, prop: str) -> MigrationBuilder:
        return self._add("unique_constraint", name=name, node_type=node_type, property=prop)

    def index(self, name: str, node_type: str, prop: str) -> MigrationBuilder:
        return self._add("index", name=name, node_type=node_type, property=prop)

    def drop_schema_object(self, name: str) -> MigrationBuilder:
        return self._add("drop_schema_object", name=name)


@dataclass(frozen=True)
class Migration:
    id: str
    up: Callable[[MigrationBuilder], object]
    down: Callable[[MigrationBuilder], object] | None = None

    def commands(self, down: bool = False) -> list[Command]:
        builder = MigrationBuilder()
        make = self.down if down else self.up
        if make is None:
            raise MigrationError(f"{self.id} can't be reverted")
        make(builder)
        return builder.commands


def checksum(commands: Sequence[Command]) -> str:
    """Lower-case hex SHA-256 of ``kind|transactional|text`` lines joined with line feeds."""
    text = "\n".join(f"{c.kind}|{c.transactional}|{c.text}" for c in commands)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Applied:
    id: str
    checksum: str
    applied_at: datetime


@dataclass
class Registry:
    """Declared types and what has been applied, as one JSON document."""

    nodes: dict[str, dict] = field(default_factory=dict)
    relations: dict[str, dict] = field(default_factory=dict)
    objects: dict[str, dict] = field(default_factory=dict)
    history: list[Applied] = field(default_factory=list)

    def run(self, command: Command, tables: dict[str, DataFrame] | None = None) -> None:
        what = json.loads(command.text)
        name = what["name"]
        if command.kind == "create_node_type":
            self.nodes[name] = what
        elif command.kind == "drop_node_type":
            self.nodes.pop(name, None)
        elif command.kind == "create_relation_type":
            for end in (what["source"], what["target"]):
                if end not in self.nodes:
                    raise MigrationError(f"{name} needs node type {end}")
            self.relations[name] = what
        elif command.kind == "drop_relation_type":
            self.relations.pop(name, None)
        elif command.kind == "unique_constraint":
            if tables and what["node_type"] in tables:
                check_unique(tables[what["node_type"]], what["property"])
            self.objects[name] = {"kind": command.kind, **what}
        elif command.kind == "index":
            self.objects[name] = {"kind": command.kind, **what}
        elif command.kind == "drop_schema_object":
            self.objects.pop(name, None)
        else:
            raise MigrationError(f"no operation {command.kind}")

    def to_json(self) -> str:
        history = [{"id": a.id, "checksum": a.checksum, "applied_at": a.applied_at.isoformat()} for a in self.history]
        return json.dumps({"nodes": self.nodes, "relations": self.relations, "objects": self.objects, "history": history}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Registry:
        held = json.loads(text)
        history = [Applied(a["id"], a["checksum"], datetime.fromisoformat(a["applied_at"])) for a in held["history"]]
        return cls(held["nodes"], held["relations"], held["objects"], history)


def duplicates(table: DataFrame, prop: str) -> DataFrame:
    """Values that occur more than once, with how often."""
    return table.filter(F.col(prop).isNotNull()).groupBy(prop).agg(F.count("*").alias("n")).filter("n > 1")


def check_unique(table: DataFrame, prop: str) -> None:
    if not duplicates(table, prop).isEmpty():
        raise MigrationError(f"{prop} isn't unique")


class RegistryStore:
    """A registry, with its history, as one file that is replaced as a whole.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> Registry:
        text = get_text(self.spark, self.path)
        return Registry() if text is None else Registry.from_json(text)

    def save(self, registry: Registry) -> None:
        put_text(self.spark, self.path, registry.to_json())


class MigrationRunner:
    """Applies migrations to a registry; with a store, what is applied is saved after each migration.

    A migration is applied as a whole: if one of its commands or the saving
    fails, the registry and the store are as they were before it.
    """

    def __init__(self, registry: Registry | None = None, tables: dict[str, DataFrame] | None = None, store: RegistryStore | None = None) -> None:
        if registry is None:
            registry = store.load() if store is not None else Registry()
        self.registry, self.tables, self.store = registry, tables, store

    def plan(self, migrations: Sequence[Migration]) -> list[Migration]:
        """What is still to be applied, in the given order."""
        seen: set[str] = set()
        done = {a.id: a.checksum for a in self.registry.history}
        out = []
        for m in migrations:
            if m.id in seen:
                raise MigrationError(f"{m.id} is given twice")
            seen.add(m.id)
            if m.id not in done:
                out.append(m)
            elif done[m.id] != checksum(m.commands()):
                raise MigrationError(f"{m.id} has changed since it was applied")
        return out

    def migrate(self, migrations: Sequence[Migration]) -> list[str]:
        todo = self.plan(migrations)
        for m in todo:
            commands = m.commands()
            self._apply(commands, lambda r, m=m, c=commands: r.history.append(Applied(m.id, checksum(c), datetime.now(UTC))))
        return [m.id for m in todo]

    def revert(self, migration: Migration) -> None:
        if migration.id not in {a.id for a in self.registry.history}:
            raise MigrationError(f"{migration.id} hasn't been applied")

        def forget(registry: Registry) -> None:
            registry.history = [a for a in registry.history if a.id != migration.id]

        self._apply(migration.commands(down=True), forget)

    def _apply(self, commands: Sequence[Command], note: Callable[[Registry], None]) -> None:
        """On a copy, which takes the registry's place when all has gone well."""
        after = deepcopy(self.registry)
        for c in commands:
            after.run(c, self.tables)
        note(after)
        if self.store is not None:
            self.store.save(after)
        for f in fields(Registry):
            setattr(self.registry, f.name, getattr(after, f.name))
