"""The declared graph: node types, relation types, and their validation.

A node type is a label with one key and a flat set of properties; a relation
type joins two node types, directed or not, with properties of its own.  A
property has the name queries use and the name of the column that holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T


class ModelError(ValueError):
    """The declared model can't be used."""


class UnknownType(KeyError):
    """A label or relation that the model doesn't have."""


class UnmappedProperty(AttributeError):
    """A property that a type doesn't have."""


@dataclass(frozen=True)
class NodeType:
    name: str
    key: str
    properties: Mapping[str, str] = field(default_factory=dict)

    def column(self, prop: str) -> str:
        if prop not in self.properties:
            raise UnmappedProperty(f"{self.name} has no property {prop}")
        return self.properties[prop]

    @property
    def key_column(self) -> str:
        return self.properties[self.key]


@dataclass(frozen=True)
class RelationType:
    name: str
    source: str
    target: str
    directed: bool = True
    properties: Mapping[str, str] = field(default_factory=dict)

    def column(self, prop: str) -> str:
        if prop not in self.properties:
            raise UnmappedProperty(f"{self.name} has no property {prop}")
        return self.properties[prop]


#: Columns that every relation table has besides its properties.
EDGE_COLUMNS = ("edge_id", "src", "dst")


@dataclass(frozen=True)
class GraphModel:
    nodes: Mapping[str, NodeType]
    relations: Mapping[tuple[str, str, str], RelationType]

    def node(self, name: str) -> NodeType:
        if name not in self.nodes:
            raise UnknownType(f"no node type {name}")
        return self.nodes[name]

    def relation(self, name: str, source: str | None = None, target: str | None = None) -> RelationType:
        """The relation of a name, told apart by its ends where the name isn't unique."""
        found = [r for r in self.relations.values() if r.name == name and source in (None, r.source) and target in (None, r.target)]
        if not found:
            raise UnknownType(f"no relation type {name}")
        if len(found) > 1:
            raise ModelError(f"{name} names several relations; give its source and target")
        return found[0]


class ModelBuilder:
    """Declares types; explicit arguments win over conventions."""

    def __init__(self) -> None:
        self._nodes: dict[str, NodeType] = {}
        self._relations: dict[tuple[str, str, str], RelationType] = {}

    def node(
        self,
        name: str,
        columns: Iterable[str],
        key: str | Iterable[str] | None = None,
        names: Mapping[str, str] | None = None,
        ignore: Iterable[str] = (),
    ) -> ModelBuilder:
        """``names`` maps a column to the property name queries use; ``ignore`` drops columns.

        Without ``key`` the property ``id`` is the key, else ``<name>_id``, in
        either case.
        """
        if name in self._nodes:
            raise ModelError(f"node type {name} is declared twice")
        properties = _properties(name, columns, names or {}, ignore)
        keys = [key] if isinstance(key, str) else list(key or [])
        if len(keys) > 1:
            raise ModelError(f"{name} has more than one key")
        chosen = keys[0] if keys else _conventional_key(name, properties)
        if chosen is None:
            raise ModelError(f"{name} has no key")
        if chosen in set(ignore):
            raise ModelError(f"{name}'s key is ignored")
        if chosen not in properties:
            raise ModelError(f"{name}'s key {chosen} is no property")
        self._nodes[name] = NodeType(name, chosen, properties)
        return self

    def relation(
        self,
        name: str,
        source: str,
        target: str,
        columns: Iterable[str] = (),
        directed: bool = True,
        names: Mapping[str, str] | None = None,
        ignore: Iterable[str] = (),
    ) -> ModelBuilder:
        if (source, name, target) in self._relations:
            raise ModelError(f"relation {name} from {source} to {target} is declared twice")
        own = [c for c in columns if c not in EDGE_COLUMNS]
        self._relations[source, name, target] = RelationType(name, source, target, directed, _properties(name, own, names or {}, ignore))
        return self

    def build(self) -> GraphModel:
        for r in self._relations.values():
            for end in (r.source, r.target):
                if end not in self._nodes:
                    raise ModelError(f"{r.name} needs node type {end}")
        return GraphModel(dict(self._nodes), dict(self._relations))


def _properties(owner: str, columns: Iterable[str], names: Mapping[str, str], ignore: Iterable[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in columns:
        if c in set(ignore):
            continue
        prop = names.get(c, c)
        if prop in out:
            raise ModelError(f"{owner} maps two columns to {prop}")
        out[prop] = c
    return out


def _conventional_key(name: str, properties: Mapping[str, str]) -> str | None:
    for wanted in ("id", f"{name}_id", f"{name}id"):
        for p in properties:
            if p.lower() == wanted.lower():
                return p
    return None


#: Types of stored properties.
SCALARS = (
    T.StringType,
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
KEYS = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def check_types(owner: str, schema: T.StructType, columns: Iterable[str], key: str | None = None) -> None:
    """Reject columns that no stored property can have."""
    for c in columns:
        kind = schema[c].dataType
        if not isinstance(kind, SCALARS):
            raise ModelError(f"{owner}.{c}: {kind.simpleString()} can't be stored as a property")
        if c == key and not isinstance(kind, KEYS):
            raise ModelError(f"{owner}.{c}: {kind.simpleString()} can't be a key")
