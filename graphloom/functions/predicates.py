"""Predicates over a type's properties.

A predicate is written as a Python function of a proxy, ``lambda p: (p.age >=
18) & p.name.startswith("A")``, and becomes a small closed tree whose values
are named parameters, numbered across the whole query.  Mistakes - unmapped
properties, comparing two properties, unknown operations - are errors when the
query is built, before any Spark action.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.model import NodeType, RelationType


class PredicateError(TypeError):
    """An expression that is no predicate over mapped properties and values."""


@dataclass(frozen=True)
class Comparison:
    prop: str
    op: str
    parameter: str


@dataclass(frozen=True)
class Logical:
    op: str
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Negation:
    inner: Predicate


@dataclass(frozen=True)
class NullCheck:
    prop: str
    is_null: bool


@dataclass(frozen=True)
class TextMatch:
    prop: str
    how: str
    parameter: str


@dataclass(frozen=True)
class Membership:
    prop: str
    parameter: str
    negated: bool = False


Predicate = Comparison | Logical | Negation | NullCheck | TextMatch | Membership

OPERATORS = ("=", "<>", ">", ">=", "<", "<=")
TEXT = ("startswith", "contains", "endswith")


class Expr:
    """A predicate being written; combines with ``&``, ``|`` and ``~``."""

    def __init__(self, make: Callable[[Parameters], Predicate]) -> None:
        self._make = make

    def __and__(self, other: object) -> Expr:
        return _both("and", self, other)

    def __or__(self, other: object) -> Expr:
        return _both("or", self, other)

    def __invert__(self) -> Expr:
        return Expr(lambda p: Negation(self._make(p)))

    def __bool__(self) -> bool:
        raise PredicateError("combine predicates with & | ~, not with and, or, not")


def _both(op: str, left: object, right: object) -> Expr:
    a, b = _as_expr(left), _as_expr(right)
    return Expr(lambda p: Logical(op, a._make(p), b._make(p)))


def _as_expr(x: object) -> Expr:
    if isinstance(x, Property):
        return x == True  # noqa: E712
    if not isinstance(x, Expr):
        raise PredicateError(f"{x!r} is no predicate")
    return x


class Property(Expr):
    """A mapped property; alone it stands for ``property = true``."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, name: str) -> None:
        super().__init__(lambda p: Comparison(name, "=", p.add(True)))
        self.name = name

    def _compare(self, op: str, value: object) -> Expr:
        _check_value(value)
        return Expr(lambda p: Comparison(self.name, op, p.add(value)))

    def __eq__(self, value: object) -> Expr:  # type: ignore[override]
        return self.is_null() if value is None else self._compare("=", value)

    def __ne__(self, value: object) -> Expr:  # type: ignore[override]
        return self.is_not_null() if value is None else self._compare("<>", value)

    def __gt__(self, value: object) -> Expr:
        return self._compare(">", value)

    def __ge__(self, value: object) -> Expr:
        return self._compare(">=", value)

    def __lt__(self, value: object) -> Expr:
        return self._compare("<", value)

    def __le__(self, value: object) -> Expr:
        return self._compare("<=", value)

    def is_null(self) -> Expr:
        return Expr(lambda p: NullCheck(self.name, True))

    def is_not_null(self) -> Expr:
        return Expr(lambda p: NullCheck(self.name, False))

    def _text(self, how: str, value: object) -> Expr:
        if not isinstance(value, str):
            raise PredicateError(f"{how} takes one text")
        return Expr(lambda p: TextMatch(self.name, how, p.add(value)))

    def startswith(self, value: str) -> Expr:
        return self._text("startswith", value)

    def contains(self, value: str) -> Expr:
        return self._text("contains", value)

    def endswith(self, value: str) -> Expr:
        return self._text("endswith", value)

    def is_in(self, values: Iterable[Any]) -> Expr:
        held = tuple(values)
        for v in held:
            _check_value(v)
        return Expr(lambda p: Membership(self.name, p.add(held)))

    def not_in(self, values: Iterable[Any]) -> Expr:
        held = tuple(values)
        for v in held:
            _check_value(v)
        return Expr(lambda p: Membership(self.name, p.add(held), negated=True))

    def __getattr__(self, name: str) -> Any:
        raise PredicateError(f"{self.name}.{name}: only direct properties and the listed operations can be used")


def _check_value(value: object) -> None:
    if isinstance(value, Expr):
        raise PredicateError("a property can be compared with a value only")


class Parameters:
    """Names values p0, p1, ... in the order in which they are met."""

    def __init__(self, held: Mapping[str, Any] | None = None) -> None:
        self.values: dict[str, Any] = dict(held or {})

    def add(self, value: Any) -> str:
        name = f"p{len(self.values)}"
        self.values[name] = value
        return name


class _Proxy:
    def __init__(self, owner: NodeType | RelationType) -> None:
        object.__setattr__(self, "_owner", owner)

    def __getattr__(self, name: str) -> Property:
        self._owner.column(name)
        return Property(name)


def translate(owner: NodeType | RelationType, written: Callable[[Any], object], parameters: Parameters) -> Predicate:
    """The tree of a predicate on ``owner``; its values go to ``parameters``."""
    return _as_expr(written(_Proxy(owner)))._make(parameters)


def all_of(old: Predicate | None, new: Predicate) -> Predicate:
    return new if old is None else Logical("and", old, new)


def rename(tree: Predicate | None, names: Mapping[str, str]) -> Predicate | None:
    """The same tree with other parameter names."""
    if tree is None or isinstance(tree, NullCheck):
        return tree
    if isinstance(tree, Logical):
        return Logical(tree.op, rename(tree.left, names), rename(tree.right, names))  # type: ignore[arg-type]
    if isinstance(tree, Negation):
        return Negation(rename(tree.inner, names))  # type: ignore[arg-type]
    return type(tree)(**{**tree.__dict__, "parameter": names[tree.parameter]})


#: Members from which on a list is joined instead of being put into the plan.
LONG_LIST = 1000


def to_column(tree: Predicate, column: Callable[[str], Column], values: Mapping[str, Any]) -> Column:
    """Three-valued logic as in the database: a comparison with null matches nothing."""
    if isinstance(tree, Comparison):
        left, right = column(tree.prop), F.lit(values[tree.parameter])
        return {
            "=": lambda: left == right,
            "<>": lambda: left != right,
            ">": lambda: left > right,
            ">=": lambda: left >= right,
            "<": lambda: left < right,
            "<=": lambda: left <= right,
        }[tree.op]()
    if isinstance(tree, Logical):
        left, right = to_column(tree.left, column, values), to_column(tree.right, column, values)
        return left & right if tree.op == "and" else left | right
    if isinstance(tree, Negation):
        return ~to_column(tree.inner, column, values)
    if isinstance(tree, NullCheck):
        return column(tree.prop).isNull() if tree.is_null else column(tree.prop).isNotNull()
    if isinstance(tree, TextMatch):
        return getattr(column(tree.prop), tree.how)(F.lit(values[tree.parameter]))
    found = column(tree.prop).isin(list(values[tree.parameter]))
    return ~found if tree.negated else found
