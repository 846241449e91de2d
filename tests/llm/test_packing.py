import glob
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, packing


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


ENCODER = bpe.Encoder(bpe.default_path())


def plain(reference, text):
    return np.array(reference.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab'stremvld  \n\t12é²½中 !?\x00", max_size=40)), max_size=6))
def test_ids_equal_the_library(reference, texts):
    assert ENCODER.encode(texts) == [plain(reference, t) for t in texts]


def test_long_texts_are_divided_safely(reference, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 50)
    texts = ["it's  a  test \n\n of words' ends  " * 20, "x" * 500, " " * 300 + "y", "<|endoftext|> z"]
    assert bpe.Encoder(bpe.default_path()).encode(texts) == [plain(reference, t) for t in texts]


def test_a_small_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    e = bpe.Encoder(bpe.default_path())
    texts = [f"some words number {i} and more {i * i}" for i in range(50)]
    for t in texts:
        assert e.encode([t]) == [plain(reference, t)]


def test_plain_path(reference):
    e = bpe.Encoder(bpe.default_path())
    e.fast = False
    assert e.encode(["a b", "<|endoftext|>"]) == [plain(reference, "a b"), plain(reference, "<|endoftext|>")]


def check_plan(histogram, limit, classes):
    plan = packing.make_plan(histogram, limit, classes)
    room = {}
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            room.setdefault(s, []).append((o, length))
    for own in room.values():
        own.sort()
        at = 0
        for o, length in own:
            assert o == at
            at += length
        assert at <= limit
    assert len(room) == plan.n_sequences
    return plan.n_sequences, -(-sum(k * v for k, v in histogram.items()) // limit)


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_are_gapless_and_within_the_limit(histogram):
    check_plan(histogram, 64, 16)


def test_plans_are_tight():
    draw = np.random.default_rng(1)
    lengths = np.clip(np.exp(draw.normal(6, 1, 40_000)).astype(int), 1, 2048)
    used, least = check_plan({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}, 2048, 256)
    assert used <= least * 1.01


def test_nnls_against_its_conditions():
    draw = np.random.default_rng(2)
    shapes = packing.patterns(12)
    target = draw.integers(0, 50, 12).astype(float)
    x = packing.nnls(shapes, target)
    a = np.zeros((12, len(shapes)))
    for j, row in enumerate(shapes):
        for c in row[row > 0]:
            a[c - 1, j] += 1
    gradient = a.T @ (target - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-4).all() and np.allclose(gradient[x > 0], 0, atol=1e-4)


def test_pack(spark, reference):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    got = [r.asDict() for r in packing.pack(df, with_ids=True).collect()]
    by = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    long = sorted(by[4], key=lambda r: r["piece"])
    ids = [i for r in long for i in r["ids"]]
    assert np.array(ids[:-1], dtype="<u4").tobytes() == plain(reference, "word " * 5000) and ids[-1] == 0
    assert [r["length"] for r in long] == [len(ids) % 2048] + [2048] * (len(ids) // 2048)
    assert [r["start"] for r in long] == [0, *np.cumsum([r["length"] for r in long])[:-1].tolist()]
    assert len(by[1]) == 2 and by[2][0]["ids"] == by[3][0]["ids"] == [0]
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in room.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 2048
    assert packing.pack(df.limit(0)).count() == 0
    assert "ids" not in packing.pack(df).columns


def test_whole_table(spark, reference):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    texts = dict(zip(*(pq.read_table(glob.glob(f"{folder}/documents.parquet")[0]).column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    from graphloom.llm.queries import op4_packing

    got = op4_packing(spark, folder).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(plain(reference, t or "")) // 4 + 1 for i, t in texts.items()}
