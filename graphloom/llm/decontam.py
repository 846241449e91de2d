"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of tokens: the masked-out
positions are ignored, so a substituted token there does not hide a match.
All windows of the benchmark are hashed under every mask; the windows of every
document are hashed the same way and joined with them.  Around each hit the
two token sequences are compared along the hit's diagonal, and the longest
stretch that agrees enough decides.

The benchmark is a stated query set: it is joined block by block, each block
bounded in tokens, and every block meets every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._io import numbered, ship, tidy
from graphloom.llm._text import Words, mix, slices, utf8

# The seeds.  1 is read, 0 is ignored.
#: Found by enumeration: every layout of disagreements that ``LEAST_AGREEMENT`` allows in
#: 13 to 25 tokens leaves a window of some seed whole, and of two halves of a longer
#: overlap one agrees as much as the whole.
SEEDS = ["11101111", "11010010111", "111110011", "1100100010111", "1110101001001", "1111111"]
#: The same for items of ``SHORT`` tokens up to one less than ``LEAST_OVERLAP``, in their whole length.
SHORT_SEEDS = ["110111", "11001011", "11111"]
#: Tokens from which an item is found by seeds.
SHORT = 8
#: Tokens in an overlap that counts, and the share of them that must agree.
LEAST_OVERLAP = 13
LEAST_AGREEMENT = 0.8
#: What an agreement and a disagreement add to a stretch: it agrees enough if the sum isn't negative.
_GAIN = (1, -4)
#: Tokens of the benchmark that are broadcast at once.
BLOCK_TOKENS = 500_000
#: Pairs of agreeing windows that are held at once, about: a text and an item that repeat one passage have the product of both.
HITS = 500_000

_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the window from each token on, one for each place where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + n] * _MULTIPLIERS[i]
    return mix(out)


_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words in lower case without punctuation, and their bounds by text."""
    data, offsets = utf8(texts)
    words = Words(data, offsets, punctuation=_PUNCTUATION)
    return words.hash, words.bounds()


class TestIndex:
    """Benchmark tokens, and the windows' hashes in order with their places."""

    __test__ = False

    def __init__(self, item_ids: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> None:
        self.item_ids, self.tokens, self.bounds = item_ids, tokens, bounds
        hashes, places = [], []
        owner = np.searchsorted(bounds, np.arange(len(tokens)), side="right") - 1
        size = np.diff(bounds)
        self.seeds = list(enumerate(SEEDS))
        few = (size >= SHORT) & (size < LEAST_OVERLAP)
        if few.any():
            self.seeds += list(enumerate(SHORT_SEEDS, len(SEEDS)))
        for salt, mask in self.seeds:
            h = _seed_hashes(tokens, mask, salt)
            start = np.arange(len(h))
            inside = owner[start] == owner[start + len(mask) - 1]
            inside &= few[owner[start]] == (salt >= len(SEEDS))
            hashes.append(h[inside])
            places.append(start[inside])
        # A very short item is its own window.
        self.short = {}
        for i in range(len(item_ids)):
            low, high = int(bounds[i]), int(bounds[i + 1])
            if 0 < high - low < SHORT:
                self.short.setdefault(high - low, []).append(i)
        key = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]
        # One bit for each hash's first 20 bits: most windows of a document stop here.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``h``, place in the benchmark) of agreeing windows, about ``HITS`` of them at a time."""
        for salt, mask in self.seeds:
            own = _seed_hashes(h, mask, salt)
            near = np.flatnonzero(self.maybe[(own >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(self.key, own[near], side="left")
            count = np.searchsorted(self.key, own[near], side="right") - low
            there = count > 0
            near, low, count = near[there], low[there], count[there]
            total = np.cumsum(count)
            i = 0
            while i < len(near):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, side="right")))
                yield np.repeat(near[i:j], count[i:j]), self.place[np.repeat(low[i:j], count[i:j]) + _ramp(count[i:j])]
                i = j


def _ramp(count: np.ndarray) -> np.ndarray:
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)


def _best_run(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch of which ``LEAST_AGREEMENT`` agree, the first of equals; (0, 0) if there is none."""
    total = np.concatenate([[0], np.cumsum(np.where(same, *_GAIN))])
    # From the first place where the least total so far is no greater, no stretch to here falls.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(np.arange(len(total)) - start))
    return int(start[end]), end


def _trimmed(same: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """Without disagreements at the ends, as far as ``LEAST_OVERLAP`` tokens are left."""
    while end - start > LEAST_OVERLAP and not same[end - 1]:
        end -= 1
    while end - start > LEAST_OVERLAP and not same[start]:
        start += 1
    return start, end


def verify(h: np.ndarray, index: TestIndex, mine: np.ndarray, theirs: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """item -> (overlap, agreements, start in the document, start in the item) of the longest overlap;
    of equals, the one with most agreements, then the first diagonal.

    Each diagonal of a document and an item is compared once.
    """
    out: dict[int, tuple[int, int, int, int]] = {}
    if not len(mine):
        return out
    item = np.searchsorted(index.bounds, theirs, side="right") - 1
    diagonal = np.unique(np.stack([item, mine - theirs], axis=1), axis=0)
    for i, shift in diagonal.tolist():
        low, high = int(index.bounds[i]), int(index.bounds[i + 1])
        a, b = max(low, -shift), min(high, len(h) - shift)
        same = index.tokens[a:b] == h[a + shift : b + shift]
        start, end = _best_run(same)
        whole = start == 0 and end == b - a == high - low  # a short item found whole
        if end - start >= LEAST_OVERLAP or whole:
            start, end = _trimmed(same, start, end)
            agree = int(same[start:end].sum())
            found = (end - start, agree, a + shift + start, a - low + start)
            if i not in out or _better(found, out[i]):
                out[i] = found
    return out


def _better(x: tuple[int, int, int, int], y: tuple[int, int, int, int]) -> bool:
    return (*x[:2], x[3] - x[2]) > (*y[:2], y[3] - y[2])


def _short_items(h: np.ndarray, index: TestIndex) -> dict[int, tuple[int, int, int, int]]:
    """Items with fewer than ``SHORT`` tokens: found only word by word."""
    out = {}
    for size, items in index.short.items():
        n = len(h) - size + 1
        for i in items if n > 0 else []:
            low = int(index.bounds[i])
            same = np.ones(n, dtype=bool)
            for k in range(size):
                same &= h[k : k + n] == index.tokens[low + k]
            if same.any():
                out[i] = (size, size, int(np.argmax(same)), 0)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The benchmark in blocks of at most ``BLOCK_TOKENS`` tokens or one item.

    Rows come to the driver one block at a time.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null").distinct()
    ids, texts, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(r.text or "") // 2 + 1
        if ids and size + n > BLOCK_TOKENS:
            yield np.array(ids), pa.array(texts, pa.large_string())
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield np.array(ids), pa.array(texts, pa.large_string())


SCHEMA = "doc_id bigint, item_id bigint, overlap bigint, agreements bigint, doc_start bigint, item_start bigint"


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, overlap, agreements, doc_start, item_start: the longest
    overlap of each document and benchmark item that share one, in tokens.

    A pair is returned if at least ``LEAST_OVERLAP`` tokens in line overlap and
    ``LEAST_AGREEMENT`` of them agree, or if the document holds a whole item
    that is shorter.  Disagreements at an overlap's ends count in the decision;
    what is returned leaves them out down to ``LEAST_OVERLAP`` tokens.  Tokens are words in lower case without punctuation.
    Null and empty texts and items share nothing; a null document id is kept, an
    item without an id is left out; repeated documents give repeated rows;
    repeated items count once; two empty tables give an empty result.  Other
    columns of either table are not read.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [_against(docs, TestIndex(ids, *_tokens(texts))) for ids, texts in _blocks(benchmark)]
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, found)


def _against(docs: DataFrame, index: TestIndex) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_TOKENS tokens and their windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                rows = _slice(batch.slice(i, j - i), own)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    return docs.mapInArrow(tidy(run), SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _slice(batch: pa.RecordBatch, index: TestIndex) -> list[tuple]:
    ids = batch.column(0).to_pylist()
    found = _found(batch.column(1), index)
    return [(ids[d], int(index.item_ids[i]), *x) for d, items in found.items() for i, x in sorted(items.items())]


def _found(texts: pa.Array, index: TestIndex) -> dict[int, dict[int, tuple]]:
    """For the texts that share an overlap with an item: place -> item -> overlap."""
    tokens, bounds = _tokens(texts)
    out: dict[int, dict[int, tuple]] = {}
    for mine, theirs in index.hits(tokens):
        doc = np.searchsorted(bounds, mine, side="right") - 1  # rises
        for d in np.unique(doc).tolist():
            low, high = int(bounds[d]), int(bounds[d + 1])
            a, b = np.searchsorted(doc, (d, d + 1))
            own = out.setdefault(d, {})
            for i, x in verify(tokens[low:high], index, mine[a:b] - low, theirs[a:b]).items():
                if i not in own or _better(x, own[i]):
                    own[i] = x
    for d in range(len(texts)) if index.short else ():
        for i, x in _short_items(tokens[int(bounds[d]) : int(bounds[d + 1])], index).items():
            out.setdefault(d, {}).setdefault(i, x)
    return {d: out[d] for d in sorted(out) if out[d]}


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that share no overlap with the benchmark, all rows and columns.

    Rows are judged one by one where they are read; nothing is shuffled.  Null
    and empty texts and null ids stay, and repeated rows too; an empty table
    gives an empty result, an empty benchmark all documents.  Columns keep
    their names, whatever they are.
    """
    ship(documents.sparkSession)
    names = documents.columns
    kept, schema = numbered(documents)
    for ids, texts in _blocks(benchmark):
        held = documents.sparkSession.sparkContext.broadcast(TestIndex(ids, *_tokens(texts)))
        kept = kept.mapInArrow(tidy(_sieve(held, names.index(text_col))), schema)
    return kept.toDF(*names)


def _sieve(held, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(place))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                keep = np.ones(j - i, dtype=bool)
                keep[list(_found(part.column(place), held.value))] = False
                yield part if keep.all() else part.filter(pa.array(keep))

    return run
