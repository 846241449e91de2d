"""Very long texts, columns named like results, nulls, repeated rows and empty tables, for the operators on documents."""

import pytest
from tokenizers import Tokenizer

from graphloom.llm import brown_lm, decontam, near_dup, packing, pii, quality, secret_scan, toxicity

WORDS = 160_000


@pytest.fixture(scope="module")
def long_docs(spark):
    body = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(WORDS))
    passage = " ".join(f"bench{i}" for i in range(20))
    rows = [(1, f"{body} {passage} token=abcdef123456 mail someone@example.org"), (2, f"{body} and other words"), (3, "x" * 1_200_000), (4, "short")]
    return spark.createDataFrame(rows, "doc_id long, text string"), passage, rows


def test_long_texts(spark, long_docs):
    docs, passage, rows = long_docs
    found = {r.doc_id: r for r in secret_scan.secret_digests(docs).collect()}
    assert found[1].n_assign == 1 and found[2].n_assign == 0 and rows[0][1][int(found[1].spans.split(":")[1]) :].startswith("token=")
    mails = {r.doc_id: r for r in pii.pii_digests(docs).collect()}
    assert mails[1].n_email == 1 and mails[3].n_email == 0
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert near[2] == (WORDS + 3 - 4, 1) and near[1][1] == 1 and near[3] == (1, 3)
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert [(r.doc_id, r.overlap) for r in decontam.overlaps(docs, bench).collect()] == [(1, 20)]
    tokens = {r.doc_id: r.n_tokens for r in brown_lm.score_documents(docs).collect()}
    assert tokens == {i: len(t.split()) + 1 for i, t in rows}


def test_long_texts_are_scored(spark, long_docs):
    docs, _, _ = long_docs
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality.quality):
        got = run(docs, labels).collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and all(0 <= r.score <= 1 for r in got)


EXTRA = "score string, spans int, n_email string, kept int, component_id string, held_out string, found string, c0 int, label int, word string, segment int, totals string"


@pytest.fixture(scope="module")
def odd(spark):
    own = ["s", 1, "n", 2, "c", "h", "f", 3, 4, "w", 5, "t"]
    rows = [(1, "one two three four five six", *own), (1, "one two three four five six", *own), (None, "a b", *[None] * 12), (2, None, *[None] * 12), (3, "", *own), (4, "key AKIA" + "A" * 20, *own)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


RUNS = [
    lambda d, ls, b: secret_scan.secret_digests(d),
    lambda d, ls, b: packing.pack(d),
    lambda d, ls, b: toxicity.toxicity(d, ls),
    lambda d, ls, b: quality.quality(d, ls),
    lambda d, ls, b: brown_lm.score_documents(d),
    lambda d, ls, b: near_dup.near_duplicates(d),
    lambda d, ls, b: pii.pii_digests(d),
]


@pytest.mark.parametrize("run", RUNS)
def test_odd_tables(spark, odd, run):
    """One row for each row, whatever else the tables hold; none for none."""
    labels = spark.createDataFrame([(1, 1, 0, "x", 1.0), (2, 0, 1, None, None), (None, 1, 1, None, None), (4, None, None, "y", 0.0)], "doc_id long, quality int, toxic int, text string, score double")
    got = run(odd, labels, None).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"]
    assert run(odd.limit(0), labels, None).count() == 0


def test_odd_benchmark(spark, odd):
    bench = spark.createDataFrame([(1, "x one two three four five six y", 3, "d"), (None, "one two", 1, None), (2, None, 2, None), (2, "two", 7, "k"), (2, "two", 7, "k")], "item_id long, text string, doc_id int, overlap string")
    got = decontam.overlaps(odd, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 2), (1, 2)]
    kept = decontam.decontaminate(odd, bench)
    assert kept.dtypes == odd.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "None"]


def test_packed_pieces_hold_the_library_s_ids(spark):
    """The query's whole rows: ids by the library, cut, summed and placed without gaps or overlaps."""
    import zlib

    import numpy as np
    import public_tokenizers

    texts = ["", None, "Hello, wörld! " * 3, "zahl 12345 " * 900, "x" * 5000, "a\n\n b\t" * 50, "日本語 text " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id, r.offset))
        times = 2 if i == 2 else 1
        assert len(own) == times * len({r.piece for r in own})
        assert sum(r.length for r in own) == times * len(ids)
        if len(ids) <= 2048:
            assert {r.piece for r in own} == {0}
        for r in own:
            assert r.length <= 2048 and (r.piece == 0 or r.start > 0) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        if times == 1:
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) / 2048 <= len(sequences) <= sum(r.length for r in got) / 2048 + 2
