import pytest
from tests.graphs import DIAMOND, graph

from graphloom.migrations import Migration, MigrationError, MigrationRunner, Registry, checksum
from graphloom.session import GraphStore, IdentityConflict, Op, Session, State
from graphloom.streaming.changes import follow_edges, merge_edges


def stored(spark, tmp_path, edges=DIAMOND):
    g = graph(spark, edges)
    store = GraphStore(spark, f"file://{tmp_path}", g.model)
    return store.create(g), store


def test_unit_of_work(spark, tmp_path):
    g, store = stored(spark, tmp_path)
    s = Session(g, store)
    e = g.relation("E")
    s.add("N", {"id": 7, "name": "new"})
    kept = s.track_query(g.nodes("N").where(lambda n: n.id == 2))[0]
    kept["name"] = "changed"
    s.remove("N", {"id": 3, "name": "n3"})
    s.connect(e, 7, 1, {"w": 4.0})
    s.connect(e, 7, 2)
    s.disconnect(e, 7, 2)
    s.disconnect(e, 1, 2)
    s.detect_changes()
    plan = s.plan()
    assert [m.op for m in plan] == [Op.ADD_NODE, Op.ADD_RELATION, Op.MODIFY_NODE, Op.DELETE_RELATION, Op.DELETE_NODE]
    assert plan[2].values == {"name": "changed"}
    assert s.save() == 5 and s.save() == 0
    again = store.open()
    assert {(r.id, r.name) for r in again.node_tables["N"].collect()} == {(1, "n1"), (2, "changed"), (4, "n4"), (7, "new")}
    # Deleting node 3 took its relations with it.
    assert {(r.src, r.dst) for r in again.edge_tables["N", "E", "N"].collect()} == {(2, 4), (7, 1)}


def test_upserts_and_misses(spark, tmp_path):
    g, store = stored(spark, tmp_path)
    s = Session(g, store)
    s.add("N", {"id": 1, "name": "again"})
    s.update("N", {"id": 99, "name": "nobody"})
    s.connect(g.relation("E"), 1, 2, {"w": 9.0})
    assert s.save() == 3
    after = store.open()
    assert {(r.id, r.name) for r in after.node_tables["N"].collect()} == {(1, "again"), (2, "n2"), (3, "n3"), (4, "n4")}
    assert [r.w for r in after.edge_tables["N", "E", "N"].filter("src = 1 and dst = 2").collect()] == [9.0]


def test_tracking_rules(spark, tmp_path):
    g, store = stored(spark, tmp_path)
    s = Session(g, store)
    row = {"id": 1, "name": "n1"}
    entry = s.attach("N", row)
    with pytest.raises(IdentityConflict):
        s.attach("N", {"id": 1, "name": "other"})
    row["name"] = "x"
    assert entry.is_modified("name") and not entry.is_modified("id")
    s.reload("N", row)
    assert row["name"] == "n1" and entry.state is State.UNCHANGED
    new = s.add("N", {"id": 50, "name": "n"})
    s.remove("N", new.values)
    assert s.plan() == []
    assert s.track_query(g.nodes("N").where(lambda n: n.id == 1))[0] is row
    s.detach(entry)
    assert entry.state is State.DETACHED
    with pytest.raises(ValueError):
        s.add("N", {"name": "no key"})
    bare = Session(g)
    bare.add("N", {"id": 9, "name": "n"})
    with pytest.raises(ValueError):
        bare.save()
    assert len(bare.plan()) == 1  # still pending


def test_stream_of_edges(spark, tmp_path):
    g, store = stored(spark, tmp_path / "store")
    new = spark.createDataFrame([(1, 2, 7.0), (4, 1, 3.0), (4, 1, 2.0)], "src long, dst long, w double")
    merged = merge_edges(g, ("N", "E", "N"), new).edge_tables["N", "E", "N"]
    assert {(r.src, r.dst, r.w) for r in merged.collect()} == {(1, 2, 7.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 1, 3.0)}
    new.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"file://{tmp_path}/in")
    follow_edges(stream, store, ("N", "E", "N"), f"file://{tmp_path}/ck").awaitTermination()
    assert store.open().edge_tables["N", "E", "N"].count() == 5


def test_migrations(spark):
    first = Migration("1", lambda b: b.create_node_type("P", "id", {"id": "string"}).unique_constraint("u", "P", "id"), lambda b: b.drop_schema_object("u").drop_node_type("P"))
    second = Migration("2", lambda b: b.create_relation_type("R", "P", "P").index("i", "P", "id"))
    people = spark.createDataFrame([("a",), ("b",)], "id string")
    r = Registry()
    run = MigrationRunner(r, {"P": people})
    assert run.migrate([first, second]) == ["1", "2"] and run.migrate([first, second]) == []
    assert set(r.nodes) == {"P"} and set(r.relations) == {"R"} and set(r.objects) == {"u", "i"}
    assert Registry.from_json(r.to_json()).to_json() == r.to_json()
    with pytest.raises(MigrationError):
        run.plan([first, first])
    with pytest.raises(MigrationError):
        run.plan([Migration("1", lambda b: b.create_node_type("Q", "id", {}))])
    with pytest.raises(MigrationError):
        run.revert(second)
    run.revert(first)
    assert [a.id for a in r.history] == ["2"] and not r.nodes
    with pytest.raises(MigrationError):
        run.revert(first)
    with pytest.raises(MigrationError):
        MigrationRunner(Registry(), {"P": people.union(people)}).migrate([first])
    assert len(checksum(first.commands())) == 64 and checksum(first.commands()) == checksum(first.commands())
