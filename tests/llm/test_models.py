"""Toxicity, quality and the class model."""

import math
import random
import re
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import brown_lm, quality, toxicity
from graphloom.llm._text import Words, utf8

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "or", "is", "ut", "emi", "ola")]


def corpus(n, seed=0):
    """(texts, toxic, quality): insults in some sentences, shouting and repetition in others."""
    draw = random.Random(seed)
    texts, toxic, good = [], [], []
    for _ in range(n):
        bad, low = draw.random() < 0.25, draw.random() < 0.25
        lines = [[draw.choice(WORDS) for _ in range(draw.randint(4, 12))] for _ in range(draw.randint(3, 9))]
        if bad:
            for line in draw.sample(lines, 2):
                line[draw.randrange(len(line))] = draw.choice(["wretchling", "oafhead", "grumbler"])
        text = ". ".join(" ".join(line) for line in lines) + "."
        if low:
            text = draw.choice([text.upper() + "!!!", text.replace(" ", " | "), " ".join([draw.choice(WORDS)] * 80)])
            bad = bad and any(w in text.lower() for w in ("wretchling", "oafhead", "grumbler"))
        texts.append(text)
        toxic.append(int(bad))
        good.append(int(not low))
    return texts, toxic, good


def share_right(score, label, at):
    return float(((np.asarray(score) >= at) == np.array(label)).mean())


def test_toxicity_learns_words_and_places():
    texts, toxic, _ = corpus(900)
    model = toxicity.fit(texts, toxic)
    held, labels, _ = corpus(300, 1)
    data, offsets = utf8(pa.array(held))
    result = toxicity._score_slice(data, offsets, model)
    score = np.array(result.field("score"))
    assert share_right(score, labels, 0.5) > 0.95 and score.min() >= 0 and score.max() <= 1
    hits = 0
    for i, t in enumerate(held):
        if labels[i] and score[i] >= 0.5:
            start, end = result.field("worst_start")[i].as_py(), result.field("worst_end")[i].as_py()
            hits += any(w in t.encode()[start:end].decode().lower() for w in ("wretchling", "oafhead", "grumbler"))
    assert hits >= 0.95 * sum(labels[i] and score[i] >= 0.5 for i in range(len(held)))


def test_noisy_or_is_that_of_its_sentences():
    texts, toxic, _ = corpus(300)
    model = toxicity.fit(texts, toxic)
    data, offsets = utf8(pa.array(["one. two! three\nfour", "", None, "..."], pa.string()))
    f, s, doc, _, _ = toxicity.sentence_features(data, offsets)
    z = model.sentences(f, s, len(doc))
    p = 1 / (1 + np.exp(-z))
    score = np.array(toxicity._score_slice(data, offsets, model).field("score"))
    assert len(z) == 4 and score[0] == pytest.approx(1 - np.prod(1 - p))
    alone = 1 / (1 + math.exp(-model.bias))
    assert score[1:] == pytest.approx([alone] * 3)


def test_quality_ranks():
    texts, _, good = corpus(900)
    model = quality.fit(texts, good)
    held, _, labels = corpus(300, 2)
    score = model.score(quality._expand(quality.features(*utf8(pa.array(held)))))
    assert share_right(score, labels, quality.THRESHOLD) > 0.95
    raw = np.sort(np.random.default_rng(0).normal(size=50))
    assert (np.diff(np.interp(raw, model.knots, model.levels)) >= 0).all()


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_one_sided_labels(fit):
    for texts, labels in (([], []), (["a"], [1]), (["a", "b"], [0, 0])):
        assert fit(texts, labels) is not None


def tables(spark, n=240):
    texts, toxic, good = corpus(n, 5)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (0, texts[0], "en", "s", 1), (None, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long")
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))] + [(5000, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_queries_over_tables(spark, run):
    docs, labels = tables(spark)
    got = run(docs, labels).collect()
    assert len(got) == docs.count()
    at = 0.5 if run is toxicity.toxicity else quality.THRESHOLD
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Every text's score recomputed, sentence by sentence and word by word, from the fitted weights."""
    docs, labels = tables(spark)
    seen = []
    true = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: seen.append(true(*a)) or seen[-1])
    got = toxicity.toxicity(docs, labels).collect()
    bias, slots = seen[0].bias, seen[0].slots.astype(np.float32)

    def slot(piece, size):
        words = Words(np.frombuffer(piece + b" ", np.uint8), np.array([0, len(piece) + 1]), (size,) if size else ())
        return int((words.prefix[0] if size else words.hash)[0] & np.uint64((1 << toxicity.BITS) - 1))

    def score(text):
        clean, any_words = 1.0, False
        for part in re.split(r"[.!?\n]", text or ""):
            words = re.sub(r"[!-/:-@\[-`{-~]", " ", part).lower().encode().split()
            for i in range(0, len(words), toxicity.LONGEST):
                own = {slot(w, 0) for w in words[i : i + toxicity.LONGEST]} | {slot(w, n) for w in words[i : i + toxicity.LONGEST] for n in toxicity.PREFIXES if len(w) > n}
                clean *= 1 - 1 / (1 + math.exp(-(bias + sum(float(slots[k]) for k in own))))
                any_words = True
        return 1 - clean if any_words else 1 / (1 + math.exp(-bias))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-6)


def test_quality_against_brute_force(spark, monkeypatch):
    """Every text's features counted in plain Python, and the score that the fitted ranking gives them."""
    docs, labels = tables(spark)
    seen = []
    true = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(true(*a)) or seen[-1])
    got = quality.quality(docs, labels).collect()
    model = seen[0]

    def features(text):
        b = (text or "").encode()
        n = len(b)
        if not n:
            return [0.0] * (len(quality.MARKS) + 13)
        w = b.lower().split()
        share = lambda test: math.log1p(100 * sum(map(test, b)) / n)
        out = [math.log1p(1000 * b.count(m) / n) for m in quality.MARKS] + [math.log1p(len(w))]
        out += [share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: 33 <= c < 127 and not chr(c).isalnum()), share(lambda c: c in b" \t\n\v\f\r")]
        out.append(math.log1p(1000 * b.count(b"\n") / n))
        if w:
            pairs = list(zip(w, w[1:], strict=False))
            out += [sum(x == y for x, y in pairs) / len(pairs) if pairs else 0, len(set(w)) / len(w), Counter(w).most_common(1)[0][1] / len(w)]
            out += [1 - len(set(pairs)) / len(pairs) if pairs else 0, sum(map(len, w)) / len(w) / 10, max(map(len, w)) / 100, sum(len(x) == 1 for x in w) / len(w)]
        return out + [0.0] * (len(quality.MARKS) + 13 - len(out))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        x = np.array(features(texts[r.doc_id]))
        z = (np.concatenate([x, x * x]) - model.centre) / model.scale
        raw = float(sum(max(-8.0, min(8.0, a)) * b for a, b in zip(z, model.w, strict=True)))
        assert r.score == pytest.approx(float(np.interp(raw, model.knots, model.levels)), abs=1e-6)


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * (400 if i == 3 else 10)) for i in range(20)] + [(5, "a"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(4, 1, 1)], "doc_id long, toxic int, text int")
    texts, known = toxicity.training_sample(docs, labels, "toxic", 5, 0, most_bytes=150)
    assert sum(len(t or "") for t in texts) <= 150 and 3 <= len(texts) == len(known) and not any(len(t) == 800 for t in texts)
    assert toxicity.training_sample(docs, labels, "toxic", 5, 0, most_bytes=150) == (texts, known)
    assert len(toxicity.training_sample(docs, labels, "toxic", 5, 0)[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = tables(spark, 60)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(toxicity.toxicity(docs, labels).select("doc_id", "score").collect(), key=str) == sorted(toxicity.toxicity(docs, flipped).select("doc_id", "score").collect(), key=str)


# --- class model -----------------------------------------------------------------------


def lm_rows(seed=0):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice(WORDS).title() for _ in range(draw.randint(0, 30)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, "ünseen " * 5), (3, rows[3][1]), (None, "ba ben")]


def test_base_score_and_counts(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "SEGMENT", 200)
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    counts = Counter()
    tokens = [[*(t or "").encode().lower().split(), b"\x00end"] for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    for t, h in zip(tokens, held, strict=True):
        if not h:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i if i is not None else -1), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    got = brown_lm.score_documents(df).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert brown_lm.score_documents(df.limit(0)).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = brown_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (got.n_known, got.train_tokens, got.n_tokens) == (0, 0, 3) and math.isfinite(got.score)


def test_probabilities_add_up():
    draw = np.random.default_rng(0)
    bigrams = np.zeros((brown_lm.UNITS, brown_lm.UNITS), dtype=np.int64)
    used = [0, 1, 2, 5, brown_lm.TOP_WORDS + 3, brown_lm.END]
    for a in used:
        for b in used:
            bigrams[a, b] = draw.integers(1, 30)
    after = bigrams.sum(axis=0)
    once = np.zeros(brown_lm.UNITS)
    once[brown_lm.TOP_WORDS + 3] = 4
    label = brown_lm.exchange(bigrams, classes=4)
    model = brown_lm.Model(np.arange(brown_lm.TOP_WORDS), label, bigrams, once, int(after[brown_lm.END]))
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    for c in set(label[used].tolist()) - {0}:
        known = sum(after[u] for u in used if label[u] == c)
        assert 10 ** model.known[c] * known + 10 ** model.unknown[c] == pytest.approx(1)
    assert label[brown_lm.END] == 0 and (label[:-1] > 0).all()


def test_exchange_separates_what_never_meets():
    n = brown_lm.UNITS
    bigrams = np.zeros((n, n), dtype=np.int64)
    bigrams[0:4, 4:8] = 25  # units 0-3 are always followed by 4-7, and those by 0-3
    bigrams[4:8, 0:4] = 25
    label = brown_lm.exchange(bigrams, classes=3)
    assert len(set(label[0:4])) == 1 and len(set(label[4:8])) == 1 and label[0] != label[4]


def test_gain_of_a_move_is_that_of_the_likelihood():
    """What the search adds up equals the change of the class bigrams' likelihood."""
    draw = np.random.default_rng(4)
    n = 12
    bigrams = draw.integers(0, 9, (n, n))

    def likelihood(label, k):
        member = np.eye(k)[label]
        t = member.T @ bigrams @ member
        g = brown_lm._gain
        return g(t).sum() - g(t.sum(axis=0)).sum() - g(t.sum(axis=1)).sum()

    start = 1 + np.argsort(np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:-1], kind="stable")) % 3
    before = likelihood(np.append(start, 0), 4)
    after = likelihood(brown_lm.exchange(bigrams, classes=4), 4)
    assert after >= before


def test_more_segments_than_a_byte_counts(spark, monkeypatch):
    """Every document comes back, whatever the number of segments in a partition."""
    monkeypatch.setattr(brown_lm, "SEGMENT", 1)
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 11}") for i in range(620)], "doc_id long, text string").coalesce(1).repartition(2)
    with batches_of(spark, 1):
        found = brown_lm.segments(df, 7, 2).select("segment").collect()
        assert len({r.segment for r in found}) == 620
        got = brown_lm.score_documents(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(620))
    assert len({(r.n_tokens, r.train_tokens) for r in got}) == 1 and all(math.isfinite(r.score) for r in got)


@contextmanager
def batches_of(spark, rows):
    """A segment ends with a batch at the earliest."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    yield
    spark.conf.set(name, before)


def class_texts():
    """Words of one ending, too rare for units of their own, part by what is beside them."""
    draw = random.Random(5)
    left, right = ([f"{side}{i}{side}" for i in range(500)] for side in ("a", "q"))
    odd = [f"m{i}zzz" for i in range(20)]
    docs = [" ".join(draw.choice(left) for _ in range(40)) if d % 2 else " ".join(draw.choice(right) for _ in range(40)) for d in range(700)]
    for i, w in enumerate(odd):
        for _ in range(8):
            own = (left, right)[i % 2]
            docs.append(f"{draw.choice(own)} {w} {draw.choice(own)}")
    return docs


def test_score_against_brute_force(spark, monkeypatch):
    """Every word chooses its class; scores follow from the classes alone, counted here anew."""
    docs = class_texts()
    seen = {}
    true = brown_lm._reclassed

    def spy(corpus, model):
        first = brown_lm.likelihood(model.table)
        own, column = true(corpus, model)
        rows = own.select("words", "totals", column).collect()
        able = [brown_lm._unsqueezed(r.totals, np.int64) >= brown_lm.LEAST_COUNT for r in rows]
        chosen = [(np.frombuffer(r.words, np.uint64), np.frombuffer(r[column], np.uint8)[a]) for r, a in zip(rows, able, strict=True)]
        seen.update(rows=chosen, first=first, last=brown_lm.likelihood(model.table), top=model.top, label=model.label)
        return own, column

    monkeypatch.setattr(brown_lm, "_reclassed", spy)
    monkeypatch.setattr(brown_lm, "SEGMENT", 3000)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    with batches_of(spark, 50):
        got = {r.doc_id: r for r in brown_lm.score_documents(df).collect()}
    assert len(got) == len(docs)
    assert seen["last"] > seen["first"] and len(seen["rows"]) > 5
    # A word has one class in all segments.
    of_hash = {}
    for words, labels in seen["rows"]:
        for w, c in zip(words.tolist(), labels.tolist(), strict=True):
            assert of_hash.setdefault(w, c) == c
    vocabulary = sorted({w for t in docs for w in t.split()})
    joined = "".join(vocabulary).encode()
    at = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary])])
    words = Words(np.frombuffer(joined, np.uint8), at)
    units = brown_lm._units(words.hash.view(np.int64), brown_lm._ending(words), seen["top"])
    label = {w: of_hash.get(h, int(seen["label"][u])) for w, h, u in zip(vocabulary, words.hash.tolist(), units.tolist(), strict=True)}
    train = [i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in docs[i].split())
    assert sum(n >= brown_lm.LEAST_COUNT for n in count.values()) > brown_lm.TOP_WORDS
    pairs, after = Counter(), Counter()
    for i in train:
        line = [0, *(label[w] for w in docs[i].split()), 0]
        pairs.update(zip(line[:-1], line[1:], strict=True))
        after.update(line[1:])
    k, total = brown_lm.CLASSES, sum(after.values())
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    once = Counter()
    for w, n in count.items():
        once[label[w]] += n == 1
    for i, t in enumerate(docs):
        line, want = [0, *(label[w] for w in t.split()), 0], 0.0
        for a, b in zip(line[:-1], line[1:], strict=True):
            share = (after[b] + 0.5) / (total + 0.5 * k)
            want += math.log10((pairs[a, b] + brown_lm.MIX * share) / (before[a] + brown_lm.MIX))
        for w in t.split():
            c = label[w]
            unknown = (once[c] + 1) / (after[c] + 2)
            want += math.log10((1 - unknown) * count[w] / after[c]) if count[w] else math.log10(unknown)
        assert got[i].score == pytest.approx(want, abs=1e-9)


def test_moved_words_follow_their_neighbours():
    table = np.zeros((4, 4))
    table[1, 1], table[2, 2], table[3, 3], table[0, 1:], table[1:, 0] = 500, 500, 500, 5, 5
    context = np.zeros((3, 8), dtype=np.int64)
    context[0, [2, 6]] = 6  # class 2 on both sides
    context[1, [3, 7]] = 6
    assert brown_lm.moved(context, np.array([1, 1, 1]), table).tolist() == [2, 3, 1]
