"""Quality by Bradley-Terry pairwise ranking.

Labels are turned into preferences: a document of label 1 is preferred to one
of label 0.  The model gives each document the score w.x of its features and
a preference the probability sigma(w.x_i - w.x_j); w is learned by logistic
loss on the feature differences.  The threshold is a score quantile: the share
of label 0 in the training sample.

The returned score maps quantiles of the sample's scores to 0..1, piecewise
linear, with the threshold quantile at ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._io import fold, ship, tidy
from graphloom.llm._text import Words, slices, utf8
from graphloom.llm.toxicity import training_sample

MAX_SAMPLE = 8000
#: Preferences of each document with label 0, against documents with label 1 drawn with a fixed seed.
PAIRS_EACH = 40
THRESHOLD = 0.3
ROUNDS = 400
RATE = 0.05
DECAY = 1e-4
SEED = 7
#: Standard deviations beyond which a feature counts no more, in training and in scoring.
FARTHEST = 8.0

#: Bytes whose share of the text is a feature of its own.
MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]_{|}~"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: shares of byte classes and of repetitions.

    All are shares or logarithms, so long and short texts compare; an empty
    text has zeros.
    """
    n = len(offsets) - 1
    words = Words(data, offsets)
    bounds = words.bounds()
    out = np.zeros((n, len(MARKS) + 13))
    kinds = _KIND[data]
    for d in range(n):
        low, high = int(offsets[d]), int(offsets[d + 1])
        size = high - low
        if not size:
            continue
        counts = np.bincount(data[low:high], minlength=256)
        classes = np.bincount(kinds[low:high], minlength=5)
        out[d, : len(MARKS)] = np.log1p(1000.0 * counts[MARKS] / size)
        a, b = int(bounds[d]), int(bounds[d + 1])
        k = b - a
        h = words.hash[a:b]
        row = [
            np.log(1 + k),
            *(np.log1p(100.0 * classes[1:] / size)),
            np.log1p(1000.0 * counts[10] / size),
        ]
        if k:
            distinct, often = np.unique(h, return_counts=True)
            length = words.end[a:b] - words.start[a:b]
            pairs = h[1:] * np.uint64(3) + h[:-1]
            row += [
                float((h[1:] == h[:-1]).mean()) if k > 1 else 0.0,
                len(distinct) / k,
                often.max() / k,
                1 - len(np.unique(pairs)) / len(pairs) if k > 1 else 0.0,
                float(length.mean()) / 10,
                float(length.max()) / 100,
                float((length == 1).mean()),
            ]
        out[d, len(MARKS) : len(MARKS) + len(row)] = row
    return out


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


class Ranker:
    """w, the centre and scale of the features, and the quantiles of the sample's scores."""

    def __init__(self, w: np.ndarray, centre: np.ndarray, scale: np.ndarray, knots: np.ndarray, levels: np.ndarray) -> None:
        self.w, self.centre, self.scale, self.knots, self.levels = w, centre, scale, knots, levels

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -FARTHEST, FARTHEST) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _expand(x: np.ndarray) -> np.ndarray:
    """Squares beside the features, so that either extreme can count against a text."""
    return np.concatenate([x, x * x], axis=1)


def fit(texts: list[str | None], labels: list[int]) -> Ranker:
    """Without labels of both kinds all documents score the threshold's level."""
    rows = []
    for i in range(0, len(texts), 256):
        data, offsets = utf8(pa.array(texts[i : i + 256], pa.large_string()))
        rows.append(features(data, offsets))
    width = 2 * (len(MARKS) + 13)
    x = _expand(np.concatenate(rows)) if rows else np.zeros((0, width))
    y = np.array(labels, dtype=int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        level = 1.0 if len(good) else 0.0 if len(bad) else THRESHOLD
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), np.array([-1.0, 1.0]), np.array([level, level]))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -FARTHEST, FARTHEST)
    draw = np.random.default_rng(SEED)
    j = np.repeat(bad, PAIRS_EACH)
    i = good[draw.integers(0, len(good), len(j))]
    w = np.zeros(width)
    m, v = np.zeros(width), np.zeros(width)
    for step in range(1, ROUNDS + 1):
        diff = (z @ w)
        lost = 1.0 / (1.0 + np.exp(np.clip(diff[i] - diff[j], -60, 60)))  # 1 - probability of the preference
        pull = np.bincount(i, weights=lost, minlength=len(z)) - np.bincount(j, weights=lost, minlength=len(z))
        g = -(pull @ z) / len(j) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Ranker(w, centre, scale, np.zeros(2), np.zeros(2))
    raw = np.sort(model.raw(x))
    share = len(bad) / len(y)
    cut = _cut(model.raw(x), y, share)
    below, above = raw[raw < cut], raw[raw >= cut]
    knots = np.concatenate([np.quantile(below, np.linspace(0, 1, 21)) if len(below) else [cut - 1.0], [cut], np.quantile(above, np.linspace(0, 1, 41))])
    levels = np.concatenate([np.linspace(0.01, THRESHOLD - 0.01, 21) if len(below) else [0.01], [THRESHOLD], np.linspace(THRESHOLD + 0.001, 0.99, 41)])
    order = np.argsort(knots, kind="stable")
    knots = np.maximum.accumulate(knots[order] + np.arange(len(knots)) * 1e-12)
    model.knots, model.levels = knots, np.maximum.accumulate(levels[order])
    return model


def _cut(raw: np.ndarray, y: np.ndarray, share: float) -> float:
    """Midway between the neighbours of the quantile ``share``."""
    by = np.sort(raw)
    k = min(max(1, round(share * len(by))), len(by) - 1)
    return float((by[k - 1] + by[k]) / 2)


def quality(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Trained on labelled rows outside the held-out fold.  Without labels every
    document scores the threshold.  Null texts count as empty; a null id is
    kept, in the fold of the empty text; repeated rows give repeated rows; an
    empty table gives an empty result.  Other columns of either table are not read.
    """
    ship(documents.sparkSession)
    texts, known = training_sample(documents, labels, "quality", folds, held, MAX_SAMPLE)
    model = fit(texts, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                x = _expand(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
