import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from graphloom.llm import decontam


def make(seed=0):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    bench = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(14, 40)))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (0, None)]
    docs, want = [], {}
    for d in range(60):
        text = [draw.choice(words) for _ in range(draw.randint(0, 120))]
        if d % 3 == 0:
            i, passage = draw.choice(bench[:12])
            passage = passage.split()
            if d % 6 == 0:  # substitutions that no eight words in a row survive
                for k in range(5, len(passage), 7):
                    passage[k] = "changed"
            at = draw.randint(0, len(text))
            text[at:at] = passage
            want.setdefault(d, set()).add(i)
        docs.append((d, ("Text: " + ", ".join(text)).upper() if d % 2 else " ".join(text)))
    docs += [(100, "x TINY, item! y"), (101, None), (102, ""), (None, bench[2][1]), (3, docs[3][1])]
    want[100], want[None] = {50}, {2}
    return docs, bench, want


def exhaustive(docs, bench):
    """All diagonals of all pairs, without seeds."""
    def words(t):
        return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    items = [(i, words(t)) for i, t in bench if words(t)]
    found = set()
    for d, t in docs:
        h = words(t)
        for i, b in items:
            for shift in range(-len(b) + 1, len(h)):
                same = np.array([b[k] == h[k + shift] for k in range(max(0, -shift), min(len(b), len(h) - shift))])
                if same.sum() < min(len(b), 10) * 0.8:
                    continue
                whole = len(same) == len(b) and 5 * same.sum() >= 4 * len(b)
                if whole or qualifies(same):
                    found.add((d, i))
    return found


def test_planted_and_exhaustive(spark, monkeypatch):
    docs, bench, want = make()
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    planted = {(k, i) for k, own in want.items() for i in own}
    one = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()}
    assert one == planted == exhaustive(docs, bench)
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 100)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()} == one
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in want)
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).count() == d.count()


def test_repetitive_texts_in_bounded_steps(monkeypatch):
    """One word over and over in a text and in items: all pairs of windows agree."""
    monkeypatch.setattr(decontam, "HITS", 1000)
    bench = pa.array(["la " * 300, "la " * 40, "x y " * 30])
    index = decontam.TestIndex(np.array([4, 5, 6]), *decontam._tokens(bench))
    texts = pa.array(["la " * 500, "no", "y x " * 100, None])
    assert max(len(m) for m, _ in index.hits(decontam._tokens(texts)[0])) < 2000
    got = decontam._found(texts, index)
    assert {d: {i: x[:2] for i, x in own.items()} for d, own in got.items()} == {0: {0: (300, 300), 1: (40, 40)}, 2: {2: (60, 60)}}
    monkeypatch.setattr(decontam, "HITS", 10**9)
    assert decontam._found(texts, index) == got


def test_seeds_tolerate_substitutions():
    """Any two substitutions within 24 tokens leave some window of some seed whole."""
    for i in range(24):
        for j in range(i, 24):
            bad = {i, j}
            assert any(not any(m == "1" and s + k in bad for k, m in enumerate(mask)) for mask in decontam.SEEDS for s in range(24 - len(mask) + 1))


def lost(size, changed, seeds):
    """The share of layouts of ``changed`` substitutions in ``size`` tokens that leave no window of a seed."""
    bad = np.zeros((len(list(combinations(range(size), changed))), size), dtype=bool)
    np.put_along_axis(bad, np.array(list(combinations(range(size), changed))).reshape(len(bad), changed), True, axis=1)
    whole = np.zeros(len(bad), dtype=bool)
    for mask in seeds:
        read = np.flatnonzero(np.array(list(mask)) == "1")
        for s in range(size - len(mask) + 1):
            whole |= ~bad[:, s + read].any(axis=1)
    return 1 - whole.mean()


def test_seeds_find_every_layout_of_the_rule():
    """All layouts up to 25 tokens; a longer overlap has a half of 13 or more tokens that agrees as much."""
    for size in range(decontam.LEAST_OVERLAP, 2 * decontam.LEAST_OVERLAP):
        assert lost(size, int(size * (1 - decontam.LEAST_AGREEMENT) + 1e-9), decontam.SEEDS) == 0, size


def test_seeds_find_short_items():
    for size in range(decontam.SHORT, decontam.LEAST_OVERLAP):
        assert lost(size, int(size * (1 - decontam.LEAST_AGREEMENT) + 1e-9), decontam.SHORT_SEEDS) == 0, size


def test_sparse_hit(spark):
    """Substitutions at places that no window of eight words in a row survives."""
    words = [f"w{i}" for i in range(15)]
    doc = ["x", *words, "y"]
    for k in (4, 8, 12):
        doc[k] = "changed"
    b = spark.createDataFrame([(7, " ".join(words)), (8, "a1 a2 a3 a4 a5 a6 a7 a8 a9")], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(doc)), (2, "q a1 a2 a3 a4 zz a6 a7 a8 a9 q")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.agreements) for r in decontam.overlaps(d, b).collect())
    assert [x[:2] for x in got] == [(1, 7), (2, 8)]


def qualifies(same):
    """The rule itself: some stretch of at least 13 tokens of which four fifths agree."""
    n = len(same)
    return any(5 * int(same[i:j].sum()) >= 4 * (j - i) for i in range(n) for j in range(i + 13, n + 1))


def test_longest_stretch_is_the_rule():
    draw = np.random.default_rng(3)
    for _ in range(1500):
        same = draw.random(draw.integers(1, 45)) < draw.choice([0.5, 0.7, 0.8, 0.9])
        s, e = decontam._best_run(same)
        assert (e - s >= 13) == qualifies(same)
        assert 5 * same[s:e].sum() >= 4 * (e - s)


def test_early_substitution_and_longer_overlap_beside_exact_run(spark):
    words = [f"w{i}" for i in range(13)]
    late = [f"v{i}" for i in range(60)]
    docs = []
    for k in range(13):  # the whole item with one token changed
        docs.append((k, " ".join(["x", "x", *words[:k], "changed", *words[k + 1 :], "y"])))
    # Twelve tokens alike, then unlike ones, then sixteen with two changed.
    far = [w if i < 12 or 30 <= i < 46 and i not in (35, 40) else f"u{i}" for i, w in enumerate(late)]
    docs.append((50, " ".join(far)))
    docs.append((60, " ".join(w if 20 <= i < 30 else f"u{i}" for i, w in enumerate(late))))  # ten alike
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(late))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap, r.agreements, r.doc_start) for r in decontam.overlaps(d, b).collect()}
    assert set(got) == {(k, 1) for k in range(13)} | {(50, 2)}
    assert all(got[k, 1] == (13, 12, 2) for k in range(13))
    assert got[50, 2] == (16, 14, 30)
    assert [r.doc_id for r in decontam.decontaminate(d, b).collect()] == [60]
