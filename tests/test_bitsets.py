import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import bitsets


def scores(spark, a, b, width):
    df = spark.createDataFrame([(bitsets.pack(a, width), bitsets.pack(b, width))], "a array<bigint>, b array<bigint>")
    return df.select(*bitsets.similarity(F.col("a"), F.col("b"), width)).first()


def test_fixed_values(spark):
    r = scores(spark, {0, 1, 4}, {1, 2, 4}, 8)
    assert tuple(r)[:6] == (2, 2, 4, 0.25, 0.75, 0.5) and r.cosine == pytest.approx(2 / 3)
    r = scores(spark, set(), set(), 8)
    assert (r.jaccard, r.cosine) == (1.0, 1.0)
    assert scores(spark, {1}, set(), 8).cosine == 0.0


def test_pack():
    assert bitsets.pack([0, 0, 63, 64], 65) == [-(1 << 63) + 1, 1]
    for bad in (lambda: bitsets.pack([8], 8), lambda: bitsets.pack([-1], 8), lambda: bitsets.pack([], 0)):
        with pytest.raises(ValueError):
            bad()


def test_random_against_sets(spark):
    draw = random.Random(1701)
    cases = []
    for width in (1, 63, 64, 65, 256):
        for density in (0.0, 0.05, 0.25, 1.0):
            cases += [(width, *({i for i in range(width) if draw.random() < density} for _ in range(2))) for _ in range(3)]
    for width in (1, 63, 64, 65, 256):
        own = [(a, b) for w, a, b in cases if w == width]
        df = spark.createDataFrame([(i, bitsets.pack(a, width), bitsets.pack(b, width)) for i, (a, b) in enumerate(own)], "i int, a array<bigint>, b array<bigint>")
        for r in df.select("i", *bitsets.similarity(F.col("a"), F.col("b"), width)).collect():
            a, b = own[r.i]
            assert (r.difference, r.intersection, r.union) == (len(a ^ b), len(a & b), len(a | b))
            assert r.jaccard == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_vectors_and_pairs(spark):
    draw = random.Random(3)
    sets = {i: {draw.randrange(40) for _ in range(draw.randrange(1, 9))} for i in range(60)}
    sets[60] = set(sets[0])
    rows = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s] + [(61, None), (62, None)], "id long, f long")
    sets[61] = sets[62] = set()
    v = bitsets.bit_vectors(rows, "id", "f", 40)
    assert {r.id: r.n_bits for r in v.collect()} == {i: len(s) for i, s in sets.items()}
    want = {(i, j) for i in sets for j in sets if i < j and (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.5}
    assert {(r.left, r.right) for r in bitsets.similar_pairs(v, 40, 0.5).collect()} == want
    with pytest.raises(Exception, match="outside the width"):
        bitsets.bit_vectors(rows, "id", "f", 10).collect()


@pytest.mark.parametrize("least", [0.2, 0.4, 0.5, 0.8, 1.0])
def test_similar_pairs_by_pairs_of_bits(spark, monkeypatch, least):
    draw = random.Random(int(least * 10))
    own = {i: frozenset(draw.sample(range(70), draw.choice([0, 1, 1, 2, 2, 3, 4, 5, 9]))) for i in range(120)}
    own |= {200 + i: own[i] for i in range(20)}  # copies
    monkeypatch.setattr(bitsets, "TOGETHER", 2)
    table = spark.createDataFrame([(i, bitsets.pack(x, 128), len(x)) for i, x in own.items()], "id long, bits array<bigint>, n_bits long")
    want = {}
    for a in own:
        for b in own:
            if a < b:
                j = len(own[a] & own[b]) / len(own[a] | own[b]) if own[a] | own[b] else 1.0
                if j >= least - 1e-12:
                    want[a, b] = j
    found = bitsets.similar_pairs(table, 128, least)
    # Candidates meet on pairs of bits: the plan has no join of rows on one bit of every vector.
    assert "key" in found._jdf.queryExecution().optimizedPlan().toString()
    got = [((r.left, r.right), r.jaccard) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)
