import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import near_dup
from graphloom.llm._text import Words, shingle_sets, utf8


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    own = {i: sets_of(t) for i, t in rows if i is not None}
    label = {i: i for i in own}
    for _ in range(len(own)):
        moved = False
        for a in own:
            for b in own:
                if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                    low = min(label[a], label[b])
                    moved |= label[a] != low or label[b] != low
                    label[a] = label[b] = low
        if not moved:
            return own, label
    return own, label


def fixture(seed=4):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [draw.choice(words) for _ in range(60)]
    rows, n = [], 0
    for _ in range(14):
        base = [draw.choice(words) for _ in range(draw.randint(8, 160))]
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(int(len(copy) * draw.choice([0, 0.01, 0.03, 0.06]))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((n := n + 1, " ".join(copy)))
    for _ in range(25):  # a passage that many share, with text of their own
        rows.append((n := n + 1, " ".join(shared + [draw.choice(words) for _ in range(draw.choice([4, 25, 60]))])))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (905, " \n"), (906, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize(("tile", "star"), [(512, 256), (4, 4)])
def test_against_brute_force(spark, monkeypatch, tile, star):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "STAR", star)
    rows = fixture()
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    own, label = brute(rows)
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in own:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(own[i]), label[i], label[i] == i)


def test_links_that_the_pivot_misses(spark):
    """a-b and b-c link, a-c don't; and two chains that share the least member's bucket."""
    base = [f"x{i}" for i in range(200)]
    rows = []
    for k in range(8):
        own = list(base)
        for j in range(k):
            own[20 * j + 5] = f"y{j}"
        rows.append((10 - k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, label = brute(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == label


def test_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c"), (3, None, "d"), (4, "", "e"), (5, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()))
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)]
    one = near_dup.deduplicate(df)
    assert one.columns == df.columns
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 4, 5]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0 and near_dup.deduplicate(df.limit(0)).count() == 0


def test_texts_of_one_id(spark):
    """An id with two texts joins what links with either; each row keeps its own size."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    near = a.replace("a39", "z")
    rows = [(1, a), (2, b), (2, near), (3, b), (4, b + " more"), (5, None), (5, "lone word"), (6, "c " * 9)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 36, 1, True), (2, 36, 1, False), (2, 36, 1, False), (3, 36, 1, False), (4, 37, 1, False), (5, 0, 5, True), (5, 1, 5, True), (6, 1, 6, True)]


def test_deduplicate_keeps_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text, 1, {"k": 1}, "x"), (1, text, 9, {"k": 2}, "y"), (1, text, 3, {"k": 3}, "z"), (1, "a" + text, 0, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, `_place` map<string,int>, `__place` string")
    got = near_dup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "a" + text, 0, None, None), (None,) * 5], key=str)


def test_one_stray_in_a_large_bucket(spark, monkeypatch):
    """A bucket of one component and a stray makes about as many rows as it has members."""
    monkeypatch.setattr(near_dup, "TILE", 64)
    n = 100_000
    rows = spark.range(n).selectExpr("7L as key", "id as node", "cast(id % 2 as int) as grade", f"{n}L as size", "if(id = 5, 5L, -1L) as label", "id = 5 as minor")
    made = near_dup._dealt(rows)
    blocks = made.filter("left").count()
    assert made.filter("right").count() == n and blocks <= 2 * (n // 64)
    assert made.groupBy("tile").count().agg({"count": "max"}).first()[0] < 150


def test_stars_reach_every_member(spark, monkeypatch):
    """From every member a chain of pairs leads to the bucket's least one, and no pivot has many members."""
    monkeypatch.setattr(near_dup, "STAR", 8)
    n = 3000
    buckets = spark.range(n).selectExpr("3L as key", "id + 10 as node", "0 as grade", "10L as pivot", f"{n}L as size").union(spark.range(5).selectExpr("4L", "id", "0", "0L", "5L"))
    pairs = [(r.a, r.b) for r in near_dup._stars(buckets).collect()]
    up = {}
    for a, b in pairs:
        assert b < a
        up.setdefault(a, b)
    for x in [*range(1, 5), *range(11, n + 10)]:
        while x in up:
            x = up[x]
        assert x in (0, 10)
    assert max(np.unique([b for _, b in pairs], return_counts=True)[1]) < 60


def test_every_pair_within_the_radius_shares_a_key():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << near_dup.BITS, (400, near_dup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = draw.choice(near_dup.HASHES, near_dup.RADIUS, replace=False)
        row[at] += 1
    assert (near_dup.chunk_keys(a) == near_dup.chunk_keys(b)).any(axis=1).all()


def test_sketches_keep_linked_pairs():
    draw = random.Random(8)
    for n in (6, 30, 300, 3000):
        for _ in range(20):
            a = [f"a{draw.random()}" for _ in range(n)]
            values, bounds = shingle_sets(Words(*utf8(pa.array([" ".join(a)]))))
            drop = max(0, int(0.25 * len(values)))
            kept = np.sort(np.random.default_rng(draw.randrange(1 << 30)).choice(values, len(values) - drop, replace=False))
            both = np.concatenate([values, kept])
            sketch = near_dup._sketches(both, np.array([0, len(values), len(both)]))
            assert near_dup._alike(sketch[:1], sketch[1])[0]
