import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import _text
from graphloom.llm._text import Words, shingle_sets, slices, utf8

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x1c\xa0é.", max_size=30)), max_size=6)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words_are_those_of_python(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    w = Words(data, offsets)
    bounds = w.bounds()
    seen = {}
    for d, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        assert bounds[d + 1] - bounds[d] == len(own)
        for i, word in zip(range(bounds[d], bounds[d + 1]), own, strict=True):
            assert data[w.start[i] : w.end[i]].tobytes().lower() == word and w.doc[i] == d
            assert seen.setdefault(word, w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


@settings(deadline=None, max_examples=100)
@given(TEXTS)
def test_shingles_are_sets(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    values, bounds = shingle_sets(Words(data, offsets))
    seen = {}
    for d, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        found = values[bounds[d] : bounds[d + 1]]
        assert len(found) == len(own) and (np.diff(found.astype(object)) > 0).all()
        seen.setdefault(frozenset(own), found.tolist())
        assert seen[frozenset(own)] == found.tolist()


def test_windows_do_not_change_words(monkeypatch):
    text = ("word " * 50 + "x" * 300 + " end\n") * 20
    whole = Words(*utf8(pa.array([text, "a b", text], pa.string())))
    monkeypatch.setattr(_text, "WINDOW_BYTES", 64)
    cut = Words(*utf8(pa.array([text, "a b", text], pa.string())))
    assert (whole.hash == cut.hash).all() and (whole.start == cut.start).all()


def test_slices_of_arrays_and_prefixes():
    column = pa.array(["zz", "abc abcd", None, "abcde"], pa.string()).slice(1)
    w = Words(*utf8(column), prefixes=(3,))
    assert [w.prefix[0][0] == 0, w.prefix[0][1] == w.prefix[0][2]] == [True, True]
    assert list(slices(np.array([0, 10, 20, 500, 510]), 25)) == [(0, 2), (2, 3), (3, 4)]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]
