"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is the logistic of
the sum of its features' weights; a document's is the noisy-or of its
sentences, 1 - prod(1 - p).  The weights are trained from document labels
alone, through the noisy-or, and then point at the offending sentences.

Features of a word are its hash and the hashes of its first bytes, so that
inflected and compounded words share weight.  Nothing but the text is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._io import fold, fresh, numbered, ship, tidy
from graphloom.llm._text import Words, slices, utf8

#: Labelled documents the weights are fitted on, at most; taken by a hash of the id.
MAX_SAMPLE = 8000
#: Bytes of text of these documents, at most: one that doesn't fit any more is left out of the sample.
MAX_SAMPLE_BYTES = 64 << 20
BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS = 25
BATCH_DOCS = 64
#: Bytes scored at once; a word has many features.
SLICE = 400_000
RATE = 0.05
DECAY = 2e-5
SEED = 11
#: Words after which a sentence without an end is cut, so that a text without stops is a bag too.
LONGEST = 24
#: A feature gets a weight if so many documents of the sample have it.
LEAST_DOCS = 8
#: ... and if its share of toxic documents is so many standard deviations from the sample's.
LEAST_DEVIATIONS = 4.0

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentence_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features, sentence of each feature, document of each sentence, start, end).

    A feature occurs once in a sentence.  Sentences end after ``. ! ?`` or a
    line break, and after every ``LONGEST`` words; start and end are byte places of their first and last word in
    ``data``.  Texts without words have no sentence.
    """
    words = Words(data, offsets, PREFIXES, _PUNCTUATION)
    if not len(words.hash):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
    section = stops[words.start]
    new = np.ones(len(section), dtype=bool)
    new[1:] = (section[1:] != section[:-1]) | (words.doc[1:] != words.doc[:-1])
    begun = np.flatnonzero(new)
    place = np.arange(len(new)) - np.repeat(begun, np.diff([*begun, len(new)]))
    new |= place % LONGEST == 0
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    mask = np.uint64((1 << BITS) - 1)
    columns, owners = [(words.hash & mask).astype(np.int64)], [sentence]
    for head in words.prefix:
        there = head != 0
        columns.append((head[there] & mask).astype(np.int64))
        owners.append(sentence[there])
    key = np.unique(np.concatenate(owners) << BITS | np.concatenate(columns))
    return key & ((1 << BITS) - 1), key >> BITS, words.doc[first], words.start[first], words.end[last]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Weights:
    """``bias`` and one weight for each feature slot."""

    def __init__(self, bias: float, slots: np.ndarray) -> None:
        self.bias, self.slots = bias, slots

    def sentences(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(owner, weights=self.slots[features], minlength=n)


def fit(texts: list[str | None], labels: list[int]) -> Weights:
    """Weights by Adam on the document log-likelihood through the noisy-or.

    Without labels of both kinds every weight is 0 and the bias gives the
    label share (a half if there is none).
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else min(0.99, max(0.01, float(y.mean())))
        return Weights(float(np.log(share / (1 - share))), np.zeros(1 << BITS))
    order = np.random.default_rng(SEED).permutation(len(y))
    own = [order[i : i + BATCH_DOCS] for i in range(0, len(order), BATCH_DOCS)]
    # Two passes over the texts, so that only telling features are ever held together.
    common = _telling(((*_features_of(texts, k), y[k]) for k in own), y.mean())
    groups = []
    for k in own:
        feature, sentence, doc = _features_of(texts, k)
        kept = common[feature]
        slots, where = np.unique(feature[kept], return_inverse=True)
        groups.append((slots, where.astype(np.int32), sentence[kept].astype(np.int32), doc, y[k]))
    w, bias = np.zeros(1 << BITS), -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb = vb = 0.0
    step = 0
    for _ in range(EPOCHS):
        for slots, where, sentence, doc, label in groups:
            step += 1
            z = bias + np.bincount(sentence, weights=w[slots][where], minlength=len(doc))
            clean = np.bincount(doc, weights=_softplus(z), minlength=len(label))  # -log of no toxic sentence
            pull = np.where(label > 0, -1.0 / np.expm1(np.maximum(clean, 1e-9)), 1.0)
            gz = _sigmoid(z) * pull[doc] / len(label)
            g = np.bincount(where, weights=gz[sentence], minlength=len(slots)) + DECAY * w[slots]
            m[slots] = 0.9 * m[slots] + 0.1 * g
            v[slots] = 0.99 * v[slots] + 0.01 * g * g
            w[slots] -= RATE * (m[slots] / (1 - 0.9**step)) / (np.sqrt(v[slots] / (1 - 0.99**step)) + 1e-6)
            gb = float(gz.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            bias -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return Weights(float(bias), w)


def _features_of(texts: list[str | None], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(pa.array([texts[j] for j in places], pa.large_string()))
    feature, sentence, doc, _, _ = sentence_features(data, offsets)
    return feature, sentence, doc


def _telling(groups: Iterable[tuple], share: float) -> np.ndarray:
    """Feature slots that enough documents have, and documents of one label more than chance allows."""
    seen, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for feature, sentence, doc, label in groups:
        key = np.unique(doc[sentence] << BITS | feature)
        slot = key & ((1 << BITS) - 1)
        seen += np.bincount(slot, minlength=1 << BITS)
        toxic += np.bincount(slot, weights=label[key >> BITS], minlength=1 << BITS)
    deviation = np.abs(toxic - share * seen) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    return (seen >= LEAST_DOCS) & (deviation >= LEAST_DEVIATIONS)


def training_sample(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int = MAX_SAMPLE, most_bytes: int = MAX_SAMPLE_BYTES
) -> tuple[list, list]:
    """(texts, labels) of at most ``most`` labelled documents outside the held-out fold, of ``most_bytes`` in all.

    The sample is chosen on ids, by a hash of the id, and on the texts' sizes,
    before any text is fetched.  Rows with a null id or label are left out; of
    several labels of an id the greatest counts; of several texts of an id, the
    first in order.
    """
    ids = documents.select("doc_id").filter("doc_id is not null").distinct()
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.join(ids, "doc_id").filter(fold(F.col("doc_id"), folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = {int(r.doc_id): r.y for r in chosen.collect()}  # in the order of the hash
    if not rows:
        return [], []

    def of(wanted: list[int]) -> DataFrame:
        picked = documents.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")
        own = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most ``most`` ids
        return own

    sizes = {r.doc_id: r.size or 0 for r in of(list(rows)).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).collect()}
    kept, total = [], 0
    for i in rows:
        if total + sizes.get(i, 0) <= most_bytes:
            kept.append(i)
            total += sizes.get(i, 0)
    if not kept:
        return [], []
    texts = {r.doc_id: r.text for r in of(kept).groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    kept = sorted(i for i in kept if i in texts)
    return [texts[i] for i in kept], [rows[i] for i in kept]


def score_toxicity(df: DataFrame, weights: Weights, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All rows and columns of ``df`` and, as the last, a struct column: score, n_offending,
    worst_start, worst_end (bytes of the worst sentence in the UTF-8 text, null where there is none).
    It is called ``name``, with underscores before it where ``df`` has that name already.
    ``text_col`` is a string.

    Texts that are null, empty or without words score the bias as one sentence.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    slots = spark.sparkContext.broadcast(weights.slots.astype(np.float32))  # 2 ** BITS values
    bias = weights.bias
    place = df.columns.index(text_col)
    plain, schema = numbered(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(bias, slots.value)
        for batch in batches:
            data, offsets = utf8(batch.column(place))
            for i, j in slices(offsets, SLICE):
                part = data[offsets[i] : offsets[j]]
                result = _score_slice(part, offsets[i : j + 1] - offsets[i], model)
                columns = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, result], names=[*batch.schema.names, "found"])

    found = T.StructType([T.StructField("score", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("n_offending", "worst_start", "worst_end"))])
    return plain.mapInArrow(tidy(run), T.StructType([*schema, T.StructField("found", found)])).toDF(*df.columns, fresh(name, df.columns))


def _score_slice(data: np.ndarray, offsets: np.ndarray, model: Weights) -> pa.Array:
    n = len(offsets) - 1
    feature, sentence, doc, start, end = sentence_features(data, offsets)
    z = model.sentences(feature, sentence, len(doc))
    soft = np.bincount(doc, weights=_softplus(z), minlength=n)
    there = np.bincount(doc, minlength=n) > 0
    soft[~there] = _softplus(np.array([model.bias]))[0]
    offending = np.bincount(doc, weights=z >= 0, minlength=n).astype(np.int64)
    worst = np.full(n, -1)
    by = np.lexsort((-np.arange(len(z)), z, doc))  # the last of a document is its highest, the first among equals
    worst[doc[by]] = by
    none = worst < 0
    worst[none] = 0
    base = offsets[:-1]
    places = [
        pa.array((x[worst] if len(x) else np.zeros(n, np.int64)) - base, mask=none | (offending == 0)) for x in (start, end)
    ]
    return pa.StructArray.from_arrays(
        [pa.array(-np.expm1(-soft)), pa.array(offending), *places],
        names=["score", "n_offending", "worst_start", "worst_end"],
    )


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_start, worst_end of every document.

    Trained on labelled rows outside the held-out fold (crc32 of the id's text
    modulo ``folds`` equal to ``held``).  Without labels every document scores
    the same.  Null and empty texts score the bias; a null id is kept, in the
    fold of the empty text; repeated rows give repeated rows; an empty table
    gives an empty result.  Other columns of either table are not read.
    """
    weights = fit(*training_sample(documents, labels, "toxic", folds, held))
    scored = score_toxicity(documents.select("doc_id", "text"), weights)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.n_offending").alias("n_offending"),
        F.col("toxicity.worst_start").alias("worst_start"),
        F.col("toxicity.worst_end").alias("worst_end"),
    )
