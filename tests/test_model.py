import pytest

from graphloom.functions.predicates import Comparison, Logical, Membership, Negation, NullCheck, Parameters, PredicateError, TextMatch, rename, translate
from graphloom.model import ModelBuilder, ModelError, NodeType, UnknownType, UnmappedProperty

PERSON = NodeType("Person", "id", {p: p for p in ("id", "age", "score", "name", "active")})


def tree(f):
    parameters = Parameters()
    return translate(PERSON, f, parameters), parameters.values


def test_keys_by_convention_and_choice():
    assert ModelBuilder().node("Person", ["ID", "name"]).build().node("Person").key == "ID"
    assert ModelBuilder().node("Person", ["person_id"]).build().node("Person").key == "person_id"
    assert ModelBuilder().node("Person", ["id", "mail"], key="mail").build().node("Person").key == "mail"


@pytest.mark.parametrize(
    "declare",
    [
        lambda b: b.node("P", ["a"]),
        lambda b: b.node("P", ["a", "b"], key=["a", "b"]),
        lambda b: b.node("P", ["id", "a"], key="a", ignore=["a"]),
        lambda b: b.node("P", ["id", "a"], names={"a": "id"}),
        lambda b: b.node("P", ["id"], key="x"),
        lambda b: b.node("P", ["id"]).node("P", ["id"]),
        lambda b: b.node("P", ["id"]).relation("R", "P", "Q").build(),
        lambda b: b.node("P", ["id"]).relation("R", "P", "P").relation("R", "P", "P"),
    ],
)
def test_bad_models(declare):
    with pytest.raises(ModelError):
        declare(ModelBuilder())


def test_names_and_unknown_types():
    m = ModelBuilder().node("P", ["id", "display_name"], names={"display_name": "name"}).relation("R", "P", "P", ["edge_id", "src", "dst", "w"]).build()
    assert m.node("P").column("name") == "display_name"
    assert dict(m.relation("R").properties) == {"w": "w"}
    with pytest.raises(UnknownType):
        m.node("Q")
    with pytest.raises(UnknownType):
        m.relation("S")
    with pytest.raises(UnmappedProperty):
        m.node("P").column("display_name")


def test_predicate_trees():
    assert tree(lambda p: p.age >= 18) == (Comparison("age", ">=", "p0"), {"p0": 18})
    assert tree(lambda p: 18 < p.age) == (Comparison("age", ">", "p0"), {"p0": 18})
    assert tree(lambda p: p.active) == (Comparison("active", "=", "p0"), {"p0": True})
    assert tree(lambda p: ~p.active)[0] == Negation(Comparison("active", "=", "p0"))
    assert tree(lambda p: p.name == None)[0] == NullCheck("name", True)  # noqa: E711
    assert tree(lambda p: p.name != None)[0] == NullCheck("name", False)  # noqa: E711
    assert tree(lambda p: p.name.startswith("A") | p.name.contains("b"))[0] == Logical("or", TextMatch("name", "startswith", "p0"), TextMatch("name", "contains", "p1"))
    assert tree(lambda p: p.age.is_in([1, 2])) == (Membership("age", "p0"), {"p0": (1, 2)})
    assert tree(lambda p: p.age.not_in([1]))[0] == Membership("age", "p0", True)
    assert rename(tree(lambda p: (p.age > 1) & p.active)[0], {"p0": "p5", "p1": "p6"}) == Logical("and", Comparison("age", ">", "p5"), Comparison("active", "=", "p6"))


@pytest.mark.parametrize("f", [lambda p: p.age > p.score, lambda p: p.name.upper(), lambda p: 5, lambda p: p.name.startswith(3), lambda p: p.age.is_in([p.score]), lambda p: p.active and p.active])
def test_bad_predicates(f):
    with pytest.raises(PredicateError):
        tree(f)


def test_unmapped_property():
    with pytest.raises(UnmappedProperty):
        tree(lambda p: p.height > 1)
