"""Language-model scoring by class-based n-grams over exchange clusters.

Words are assigned to classes by exchange clustering: each unit moves to the
class that raises the average mutual information of neighbouring classes most.
It begins with the ``TOP_WORDS`` most frequent words, each by itself, and all
other words in groups of their ending.  Then every word that occurs at least
``LEAST_COUNT`` times, however many there are, moves by itself: in a round the
classes beside it are counted over the corpus and all words move at once, as
long as the likelihood of the class bigrams rises.  Rarer and unseen words
keep the class of their ending.  A text's probability is

    prod over tokens of  P(class | class before) * P(word | class),

with class transitions interpolated with class frequencies, and in each class
a share kept for unknown words, estimated from the words seen once.

The corpus is encoded once into segments of about a million tokens, each with
its own dictionary.  Words are dealt into buckets by their hash; a segment sends
what it knows of a bucket's words in one row, so word counts are summed over
dictionaries, not over tokens, and come back to each segment for its own words,
and so do the classes that words choose.  The buckets grow in number with the
corpus, so neither the vocabulary nor a document's words are ever in one place.
A segment's row holds all that is known of its words, so that counting contexts
and scoring read rows one by one, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._io import fold, release, ship, tidy
from graphloom.llm._text import LOWER, Words, mix, slices, utf8
from graphloom.plans.lineage import drop_written, scratch, written

#: Words that are units by themselves.
TOP_WORDS = 768
#: Groups of endings for all other words.
ENDINGS = 255
CLASSES = 48
PASSES = 6
#: Training tokens of a word from which it has a class of its own choice.
LEAST_COUNT = 5
#: Rounds in which all such words move at once.
ROUNDS = 2
#: Tokens of a segment, about; a longer document is a segment of its own.
SEGMENT = 800_000
#: Tokens of a segment that are scored at once, about.
CHUNK = 250_000
#: Entries of segments' dictionaries in a bucket, about.
BUCKET = 100_000
#: Entries that a bucket holds before it adds them up.
PENDING = 1_000_000
#: Bytes of a Parquet row group of segments: readers hold a whole one.
GROUP_BYTES = 8 << 20
#: Weight of class frequencies against transitions, in tokens.
MIX = 50.0
UNITS = TOP_WORDS + ENDINGS + 1
#: The unit of the end of a text.
END = UNITS - 1


# --- segments -------------------------------------------------------------------


def _ending(words: Words) -> np.ndarray:
    """The group of a word's last three bytes, in lower case."""
    low, end = words.start, words.end
    code = np.zeros(len(low), dtype=np.uint64)
    for k in (3, 2, 1):
        there = end - k >= low
        code = code * np.uint64(257) + np.where(there, LOWER[words.data[np.maximum(end - k, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(ENDINGS)).astype(np.uint8)


SEGMENT_SCHEMA = "segment bigint, size bigint, docs binary, nulls binary, held binary, bounds binary, tokens binary, words binary, endings binary, counts binary"


class _Builder:
    """Collects documents into a segment."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.endings: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: pa.Array, held: np.ndarray, words: Words) -> None:
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(docs.is_null().to_numpy(zero_copy_only=False))
        self.held.append(held)
        self.sizes.append(np.diff(words.bounds()))
        self.hashes.append(words.hash)
        self.endings.append(_ending(words))
        self.n += len(words.hash)

    def row(self, segment: int) -> pa.RecordBatch:
        """Counts are those of training documents; a word of held-out ones only has 0."""
        hashes, sizes, held = (np.concatenate(x) for x in (self.hashes, self.sizes, self.held))
        words, first, tokens, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which compress well.
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        words, first, tokens = words[order], first[order], rank[tokens]
        train = ~np.repeat(held, sizes)
        counts = np.bincount(tokens[train], minlength=len(words))
        endings = np.concatenate(self.endings)[first]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        raw = [
            _squeezed(np.concatenate(self.docs).astype(np.int64)),
            np.concatenate(self.nulls).tobytes(),
            held.tobytes(),
            _squeezed(bounds.astype(np.int64)),
            _squeezed(tokens),
            words.tobytes(),
            endings.tobytes(),
            counts.astype(np.uint32).tobytes(),
        ]
        names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
        size = len(words)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=names)


def _squeezed(values: np.ndarray) -> bytes:
    """The number of values, then their bytes compressed: the low bytes of all values first, then the next ones."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, kind: type) -> np.ndarray:
    n, wide = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=wide * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(kind).ravel()


def segments(documents: DataFrame, folds: int, held: int) -> DataFrame:
    """The corpus as rows of ``SEGMENT_SCHEMA``."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 33  # more than a partition can have
        builder = _Builder()
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                builder.add(batch.column(0).slice(i, j - i), out[i:j], words)
                if builder.n >= SEGMENT:
                    yield builder.row(segment)
                    segment, builder = segment + 1, _Builder()
        if builder.docs:
            yield builder.row(segment)

    chosen = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held"), F.col("text").cast("string").alias("text")
    )
    return chosen.mapInArrow(tidy(run), SEGMENT_SCHEMA)


# --- buckets of words -------------------------------------------------------------


def _dealt(segment: int, words: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.RecordBatch:
    """bucket, segment, words and the columns: one row for each bucket that has words of a segment."""
    bucket = ((words.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    bounds = np.append(first, len(bucket))
    packed = [_cut(x[order], bounds) for x in (words, *columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), segment, np.int64)), *packed], names=["bucket", "segment", "words", *columns])


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value for each range of ``values``."""
    raw = np.ascontiguousarray(values)
    offsets = (bounds * raw.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _by_bucket(rows: DataFrame) -> DataFrame:
    """The rows of a bucket come together, one bucket after another."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """For each bucket, its rows; rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and held[-1].column(0)[0].as_py() != int(bucket[i]):
                yield held
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held


class _Sums:
    """Sums of rows of numbers by word; what waits to be added is bounded."""

    def __init__(self, wide: int) -> None:
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros((0, wide), np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, words: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        self.wait.append((words, column, value))
        self.n += len(words)
        if self.n >= PENDING:
            self.settle()

    def settle(self) -> None:
        if not self.wait:
            return
        words, column, value = (np.concatenate(x) for x in zip(*self.wait, strict=True))
        every = np.union1d(self.words, words)
        sums = np.zeros((len(every), self.sums.shape[1]), np.int64)
        sums[np.searchsorted(every, self.words)] = self.sums
        wide = sums.shape[1]
        sums += np.bincount(np.searchsorted(every, words) * wide + column, weights=value, minlength=sums.size).astype(np.int64).reshape(sums.shape)  # exact below 2 ** 53
        self.words, self.sums, self.wait, self.n = every, sums, [], 0

    def of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, words)


_COUNTED = "segment bigint, places binary, totals binary, word bigint, total bigint, ending smallint, known bigint, singles bigint"


def _counted(encoded: DataFrame) -> DataFrame:
    """Counts of words over the corpus, in three kinds of rows: (segment, places, totals) for
    each bucket and segment; (word, total, ending) of a bucket's most frequent words; and
    (ending, known, total, singles): a bucket's words of an ending that occur, their tokens
    and how many of them occur once."""
    entries = encoded.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-entries // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = _read(batch, r)
                yield _dealt(batch.column(0)[r].as_py(), s["words"], buckets, places=np.arange(len(s["words"]), dtype=np.int32), endings=s["endings"], counts=s["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield from _bucket_counts(rows)

    sent = encoded.select("segment", "words", "endings", "counts").mapInArrow(tidy(deal), "bucket int, segment bigint, words binary, places binary, endings binary, counts binary")
    return _by_bucket(sent).mapInArrow(tidy(add), _COUNTED)


def _bucket_counts(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums(1)
    for batch in rows:
        for r in range(batch.num_rows):
            s = _read(batch, r)
            sums.add(s["words"], np.zeros(len(s["words"]), np.intp), s["counts"].astype(np.int64))
    sums.settle()
    total = sums.sums[:, 0]
    ending = np.zeros(len(total), dtype=np.int16)
    for batch in rows:
        back = []
        for r in range(batch.num_rows):
            s = _read(batch, r)
            at = sums.of(s["words"])
            ending[at] = s["endings"]
            back.append(total[at].tobytes())
        yield _filled(_COUNTED, batch.num_rows, segment=batch.column("segment"), places=batch.column("places"), totals=pa.array(back, pa.binary()))
    there = np.flatnonzero(total > 0)
    most = there[np.lexsort((sums.words[there], -total[there]))][:TOP_WORDS]
    yield _filled(_COUNTED, len(most), word=pa.array(sums.words[most]), total=pa.array(total[most]), ending=pa.array(ending[most]))
    own = ending[there].astype(np.int64)
    tokens = np.zeros(ENDINGS, np.int64)
    np.add.at(tokens, own, total[there])
    kinds = np.flatnonzero(tokens)
    yield _filled(
        _COUNTED,
        len(kinds),
        total=pa.array(tokens[kinds]),
        ending=pa.array(kinds.astype(np.int16)),
        known=pa.array(np.bincount(own, minlength=ENDINGS)[kinds]),
        singles=pa.array(np.bincount(own[total[there] == 1], minlength=ENDINGS)[kinds]),
    )


def _filled(ddl: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the schema with nulls in all other columns."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


# --- classes --------------------------------------------------------------------


def _bigrams(corpus: DataFrame, top: np.ndarray) -> np.ndarray:
    """How often unit j follows unit i in training documents, ends included.

    Each task sums its own table of ``UNITS`` squared and sends its rows.
    """
    held = corpus.sparkSession.sparkContext.broadcast(np.sort(top))  # TOP_WORDS hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(UNITS * UNITS, dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                _add_bigrams(table, _read(batch, r), held.value)
        there = np.flatnonzero(table)
        for i in range(0, len(there), 65_536):
            own = there[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(table[own])], names=["pair", "n"])

    rows = corpus.mapInArrow(tidy(run), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # UNITS ** 2 rows at most
    out = np.zeros(UNITS * UNITS, dtype=np.int64)
    out[rows.pair.to_numpy(dtype=np.int64)] = rows.n.to_numpy()
    return out.reshape(UNITS, UNITS)


_KINDS = {
    "nulls": bool, "held": bool, "words": np.int64, "endings": np.uint8, "counts": np.uint32, "labels": np.uint8, "before": np.uint8,
    "bigrams": np.int64, "places": np.int32, "sizes": np.int32,
}
#: Columns that are kept compressed.
_SQUEEZED = {"docs": np.int64, "bounds": np.int64, "tokens": np.uint32, "totals": np.int64}


def _read(row: pa.RecordBatch | pa.Table, r: int) -> dict[str, np.ndarray]:
    names = row.schema.names
    out = {k: np.frombuffer(row.column(k)[r].as_py(), t) for k, t in _KINDS.items() if k in names}
    return out | {k: _unsqueezed(row.column(k)[r].as_py(), t) for k, t in _SQUEEZED.items() if k in names}


def _units(words: np.ndarray, endings: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The unit of each word of a dictionary; ``top`` is sorted."""
    out = TOP_WORDS + endings.astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, words), len(top) - 1)
        found = top[at] == words
        out[found] = at[found]
    return out


def _add_bigrams(table: np.ndarray, s: dict[str, np.ndarray], top: np.ndarray) -> None:
    unit = _units(s["words"], s["endings"], top)
    sizes = np.diff(s["bounds"])
    line = _with_ends(unit[s["tokens"]], sizes)
    train = ~np.repeat(s["held"], sizes + 1)
    table += np.bincount((line[:-1] * UNITS + line[1:])[train], minlength=UNITS * UNITS)


def _class_bigrams(line: np.ndarray, train: np.ndarray, k: int) -> np.ndarray:
    """How often a class follows another; ``train`` tells the transitions of training documents."""
    pair = line[:-1].astype(np.int32) * k
    pair += line[1:]
    return np.bincount(pair[train], minlength=k * k)


def _class_line(s: dict[str, np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a segment's tokens with ends, in few bytes; which transitions are those of training documents;
    which places are tokens."""
    sizes = np.diff(s["bounds"])
    inner = np.ones(int(s["bounds"][-1]) + len(sizes) + 1, dtype=bool)
    inner[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
    line = np.zeros(len(inner), dtype=np.int16)
    line[inner] = label.astype(np.int16)[s["tokens"]]
    return line, ~np.repeat(s["held"], sizes + 1), inner


def _contexts(tokens: np.ndarray, chosen: np.ndarray, line: np.ndarray, train: np.ndarray, inner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the chosen words, in training documents: (word's place times 2k plus what is beside it), and how often; the
    classes after a word are 0 to k - 1, those before it k to 2k - 1."""
    use = np.zeros(len(line), dtype=bool)
    use[inner] = chosen[tokens]
    use[:-1] &= train
    at = np.flatnonzero(use)
    word = tokens[use[inner]]
    narrow = len(chosen) * 2 * k < 2**31
    key = np.empty(2 * len(at), dtype=np.int32 if narrow else np.int64)
    key[: len(at)] = word
    key[len(at) :] = word
    key *= 2 * k
    key[: len(at)] += line[at + 1]
    key[len(at) :] += line[at - 1] + np.int16(k)
    del use, at, word
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first].astype(np.int64), np.diff(np.append(first, len(key)))


def moved(context: np.ndarray, label: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word, given the classes after and before it and the class bigrams.

    The gain is that of the likelihood for a small change of the table; the
    word's own tokens count in its class, so a word stays unless another class gains.
    """
    k = len(table)
    log = np.log(table + 0.5)
    out, into = context[:, :k].astype(np.float64), context[:, k:].astype(np.float64)
    gain = out @ log.T + into @ log
    gain -= out.sum(axis=1)[:, None] * np.log(table.sum(axis=1) + 0.5 * k)[None, :]
    gain -= into.sum(axis=1)[:, None] * np.log(table.sum(axis=0) + 0.5 * k)[None, :]
    gain[:, 0] = -np.inf
    best = np.argmax(gain, axis=1)
    here = np.arange(len(label))
    return np.where(gain[here, best] > gain[here, label] + 1e-9, best, label)


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, as far as it depends on the classes."""
    t = table.astype(np.float64)
    return float(_gain(t).sum() - _gain(t.sum(axis=0)).sum() - _gain(t.sum(axis=1)).sum())


def _with_ends(line: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An end, then each document's units and an end."""
    out = np.full(len(line) + len(sizes) + 1, END, dtype=np.int64)
    out[1 + np.arange(len(line)) + np.repeat(np.arange(len(sizes)), sizes)] = line
    return out


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each unit.

    The end has class 0 to itself.  Other units start by falling frequency,
    in turn, and then move, one after another, to the class that makes the
    log-likelihood of the class bigrams highest, until nothing moves.
    """
    n = len(bigrams)
    follow = bigrams.astype(np.float64)
    total = follow.sum(axis=0) + follow.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    order = order[order != n - 1]
    label = np.zeros(n, dtype=np.int64)
    label[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    table = member.T @ follow @ member
    right, left = follow @ member, follow.T @ member  # unit to class after, unit to class before
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    others = np.arange(1, classes)
    for _ in range(passes):
        moved = 0
        for w in order.tolist():
            if not total[w]:
                continue
            old = label[w]
            own = follow[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[old] -= own
            into[old] -= own
            # Without w:
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            so, si = out.sum() + own, into.sum() + own
            rows[old] -= so
            columns[old] -= si
            base_r, base_c = _gain(table), None
            delta = (_gain(table + out[None, :]) - base_r).sum(axis=1) + (_gain(table + into[:, None]) - base_r).sum(axis=0)
            diagonal = np.diagonal(table)
            delta += (
                _gain(diagonal + out + into + own) - _gain(diagonal + out) - _gain(diagonal + into) + _gain(diagonal)
            )
            delta -= _gain(rows + so) - _gain(rows) + _gain(columns + si) - _gain(columns)
            new = int(others[np.argmax(delta[1:])])
            if delta[new] <= delta[old] + 1e-9:
                new = old
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            rows[new] += so
            columns[new] += si
            if new != old:
                moved += 1
                label[w] = new
                right[:, old] -= follow[:, w]
                right[:, new] += follow[:, w]
                left[:, old] -= follow[w]
                left[:, new] += follow[w]
        if not moved:
            break
    return label


class Model:
    """Classes of units, class transitions and, for each class, the log10 shares of
    known tokens (to be multiplied by a word's count) and of an unknown one."""

    def __init__(self, top: np.ndarray, label: np.ndarray, bigrams: np.ndarray, once: np.ndarray, ends: int) -> None:
        self.top, self.label = top, label
        k = int(label.max()) + 1
        member = np.zeros((len(label), k))
        member[np.arange(len(label)), label] = 1
        self.once = member.T @ once
        self.estimate(member.T @ bigrams @ member)

    def estimate(self, table: np.ndarray) -> None:
        """Probabilities from the class bigrams."""
        self.table = table
        k = len(table)
        after = table.sum(axis=0)
        share = (after + 0.5) / (after.sum() + 0.5 * k)
        self.transition = np.log10((table + MIX * share[None, :]) / (table.sum(axis=1, keepdims=True) + MIX))
        unknown = (self.once + 1.0) / (after + 2.0)
        unknown[0] = 0.0  # the end is the only token of its class
        with np.errstate(divide="ignore"):
            self.known = np.log10(1.0 - unknown) - np.log10(np.maximum(after, 1.0))
            self.unknown = np.log10(unknown)
        if not after[0]:
            self.known[0] = 0.0


# --- scores ---------------------------------------------------------------------


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(s: dict[str, np.ndarray], count: np.ndarray, label: np.ndarray, model: Model, tokens: int, distinct: int, ends: int) -> pa.RecordBatch:
    """One row for each document of a segment; ``count`` and ``label`` belong to the segment's words."""
    bounds = s["bounds"]
    sizes = np.diff(bounds)
    n = len(sizes)
    with np.errstate(divide="ignore"):
        emission = np.where(count > 0, model.known[label] + np.log10(np.maximum(count, 1)), model.unknown[label])
    base = np.log10((count + 1.0) / (tokens + distinct + 1.0))
    end = np.log10((ends + 1.0) / (tokens + distinct + 1.0))
    score, base_score, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    i = 0
    while i < n:  # some documents at a time, to hold few numbers for each token
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, side="right")) - 1)
        own = sizes[i:j]
        doc = np.repeat(np.arange(j - i), own)
        word = s["tokens"][bounds[i] : bounds[j]]
        line = _with_ends(label[word], own)
        # The end's place in ``line`` belongs to class 0.
        ends_at = np.cumsum(own + 1)
        line[0] = 0
        line[ends_at] = 0
        step = model.transition[line[:-1], line[1:]]
        score[i:j] = np.add.reduceat(step, np.concatenate([[0], ends_at[:-1]])) + np.bincount(doc, weights=emission[word], minlength=j - i)
        base_score[i:j] = np.bincount(doc, weights=base[word], minlength=j - i) + end
        known[i:j] = np.bincount(doc, weights=(count > 0)[word], minlength=j - i).astype(np.int64) + (1 if ends else 0)
        i = j
    return pa.RecordBatch.from_arrays(
        [
            pa.array(s["docs"], mask=s["nulls"]),
            pa.array(s["held"]),
            pa.array(sizes + 1, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(np.full(n, tokens), pa.int64()),
            pa.array(base_score),
            pa.array(score),
        ],
        names=[c.split()[0] for c in RESULT.split(", ")],
    )


def score_documents(documents: DataFrame, folds: int = 7, held: int = 2, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from rows outside the held-out fold.  Null and empty texts are the
    end alone; a null id's fold is that of the empty text; repeated rows count
    repeatedly and give repeated rows.  Without training rows every word is
    unknown.  An empty input gives an empty result.  Other columns are not read.
    """
    spark = documents.sparkSession
    if classes > 256:
        raise ValueError("a class is one byte")
    with scratch(spark) as kept:
        encoded = _stored(segments(documents, folds, held), "segments")
        counted = written(_counted(encoded), "counts")
        ends = documents.filter(fold(F.col("doc_id"), folds) != held).count()
        sums = counted.filter("known is not null").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
        model = _first_model(encoded, counted, classes, ends)
        tokens, distinct = int(sums.n) + ends, int(sums.v) + (1 if ends else 0)
        corpus = _stored(_with_totals(encoded, counted, model), "corpus")
        drop_written(encoded)
        drop_written(counted)
        corpus, labels = _reclassed(corpus, model)
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    s = _read(batch, r)
                    yield _scores(s, s["totals"], s["labels"], shared.value, tokens, distinct, ends)

        return kept(corpus.select("docs", "nulls", "held", "bounds", "tokens", "totals", F.col(labels).alias("labels")).mapInArrow(tidy(run), RESULT), "scores")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows of MBs that are compressed already.  Without the second option a writer holds a hundred of them before it looks at their size."""
    return written(rows, name, **{"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "none"})


def _first_model(encoded: DataFrame, counted: DataFrame, classes: int, ends: int) -> Model:
    """The model over units: frequent words by themselves, all others by their ending."""
    most = counted.filter("word is not null").orderBy(F.desc("total"), "word").select("word", "total", "ending").limit(TOP_WORDS).toPandas()
    most = most.sort_values("word")
    top = most.word.to_numpy(dtype=np.int64)
    # Words seen once, by their unit; top words are among them only in a very small corpus.
    once = np.zeros(UNITS)
    for r in counted.filter("known is not null").groupBy("ending").agg(F.sum("singles").alias("n")).collect():  # ENDINGS rows
        once[TOP_WORDS + r.ending] = r.n
    single = np.flatnonzero(most.total.to_numpy() == 1)
    np.subtract.at(once, TOP_WORDS + most.ending.to_numpy(dtype=np.int64)[single], 1)
    once[single] = 1
    bigrams = _bigrams(encoded.select("held", "bounds", "tokens", "words", "endings"), top)
    return Model(top, exchange(bigrams, classes), bigrams, once, ends)


# --- segments with all that is known of their words -------------------------------------


CORPUS = pa.schema([("segment", pa.int64()), *((c, pa.binary()) for c in ("docs", "nulls", "held", "bounds", "tokens", "words", "totals", "labels", "before", "bigrams"))])
_CORPUS_DDL = ", ".join(f"{f.name} {'bigint' if f.name == 'segment' else 'binary'}" for f in CORPUS)


def _joined(segments: DataFrame, rows: DataFrame, fill) -> DataFrame:
    """Rows of ``CORPUS``: what ``fill`` makes of each segment (a row and its arrays) and of its rows."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.Table.from_batches([], schema=CORPUS)
        if left.num_rows > 1:
            raise RuntimeError(f"{left.num_rows} segments have the number {key[0].as_py()}")
        s = _read(left, 0)
        new = {k: _squeezed(v) if k in _SQUEEZED else v.tobytes() for k, v in fill(s, right).items()}
        there = [new[c] if c in new else left.column(c)[0].as_py() for c in CORPUS.names]
        del s, new
        release()
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(there, CORPUS, strict=True)], schema=CORPUS)

    return segments.groupBy("segment").cogroup(rows.groupBy("segment")).applyInArrow(run, _CORPUS_DDL)


def _all(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    """The arrays of all rows."""
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)


def _with_totals(encoded: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """Segments with the corpus's count of each of their words, its class by unit, and their class bigrams."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    k = len(model.table)

    def fill(s: dict[str, np.ndarray], right: pa.Table) -> dict[str, np.ndarray]:
        totals = np.zeros(len(s["words"]), dtype=np.int64)
        totals[_all(right, "places", np.int32)] = _all(right, "totals", np.int64)
        label = shared.value.label[_units(s["words"], s["endings"], shared.value.top)].astype(np.uint8)
        line, train, _ = _class_line(s, label)
        # From here on only words that choose their class are told apart by their hash.
        return {"totals": totals, "words": s["words"][totals >= LEAST_COUNT], "labels": label, "before": label, "bigrams": _class_bigrams(line, train, k)}

    return _joined(encoded.drop("counts", "size"), counted.filter("segment is not null").select("segment", "places", "totals"), fill)


def _with_labels(corpus: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Segments with the classes that words have chosen: rows of (segment, places, labels)."""

    def fill(s: dict[str, np.ndarray], right: pa.Table) -> dict[str, np.ndarray]:
        label = s["labels"].copy()
        label[_all(right, "places", np.int32)] = _all(right, "labels", np.uint8)
        line, train, _ = _class_line(s, label)
        return {"labels": label, "before": s["labels"], "bigrams": _class_bigrams(line, train, k)}

    return _joined(corpus, chosen, fill)


def _table(corpus: DataFrame, k: int) -> np.ndarray:
    """Class bigrams of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                total += np.frombuffer(batch.column(0)[r].as_py(), np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["pair", "n"])

    out = np.zeros(k * k, dtype=np.int64)
    for r in corpus.select("bigrams").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # k ** 2 rows
        out[r.pair] = r.n
    return out.reshape(k, k)


def _reclassed(corpus: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """The corpus with the classes that words chose, and the column that holds them; ``model`` is estimated anew.

    A round counts, segment by segment, the classes beside each word of at
    least ``LEAST_COUNT`` tokens, sums them by word, and lets all words move.
    The class bigrams are counted again afterwards; a round that doesn't raise
    their likelihood is undone and is the last.
    """
    k = len(model.table)
    table = _table(corpus, k)
    for _ in range(ROUNDS):
        model.estimate(table.astype(np.float64))
        chosen = written(_chosen(corpus, table), "classes")
        after = _stored(_with_labels(corpus, chosen, k), "corpus")
        drop_written(corpus)
        drop_written(chosen)
        corpus, new = after, _table(after, k)
        if likelihood(new) <= likelihood(table):
            return corpus, "before"
        table = new
    model.estimate(table.astype(np.float64))
    return corpus, "labels"


def _chosen(corpus: DataFrame, table: np.ndarray) -> DataFrame:
    """segment, places, labels of every word with ``LEAST_COUNT`` training tokens, wherever it occurs."""
    k = len(table)
    shared = corpus.sparkSession.sparkContext.broadcast(table.astype(np.float64))
    entries = corpus.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    buckets = max(1, -(-entries // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield _beside(_read(batch, r), batch.column("segment")[r].as_py(), k, buckets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield from _choices(rows, shared.value)

    lines = corpus.select("segment", "held", "bounds", "tokens", "words", "totals", "labels")
    found = _by_bucket(lines.mapInArrow(tidy(deal), _BESIDE))
    return found.mapInArrow(tidy(choose), "segment bigint, places binary, labels binary")


_BESIDE = "bucket int, segment bigint, words binary, places binary, labels binary, sizes binary, what binary, often binary"


def _beside(s: dict[str, np.ndarray], segment: int, k: int, buckets: int) -> pa.RecordBatch:
    """A segment's words that may choose, with the classes beside them: ``sizes`` of each word's entries in ``what`` and ``often``.

    A word that occurs in held-out documents of the segment only has no
    entries: it learns its class from other segments.
    """
    able = s["totals"] >= LEAST_COUNT
    line, train, inner = _class_line(s, s["labels"])
    code, n = _contexts(s["tokens"], able, line, train, inner, k)
    place = np.flatnonzero(able)
    at = np.append(np.searchsorted(code, place * (2 * k)), len(code))
    batch = _dealt(segment, s["words"], buckets, places=place.astype(np.int32), labels=s["labels"][place], sizes=np.diff(at).astype(np.int32), first=at[:-1])
    # Entries go where their words went.
    first, sizes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("first", np.int64), ("sizes", np.int32)))
    ends = np.cumsum(sizes, dtype=np.int64)
    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
    words_at = np.cumsum([0, *(len(x.as_py()) // 8 for x in batch.column("words"))])
    bounds = np.concatenate([[0], ends])[words_at]
    columns = [batch.column(c) for c in ("bucket", "segment", "words", "places", "labels", "sizes")]
    what = (code[entry] % (2 * k)).astype(np.uint16)
    return pa.RecordBatch.from_arrays([*columns, _cut(what, bounds), _cut(n[entry].astype(np.int32), bounds)], names=[c.split()[0] for c in _BESIDE.split(", ")])


def _choices(rows: list[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The class of the words of a bucket."""
    sums = _Sums(2 * len(table))
    for batch in rows:
        for r in range(batch.num_rows):
            s = _read(batch, r)
            what = np.frombuffer(batch.column("what")[r].as_py(), np.uint16)
            often = np.frombuffer(batch.column("often")[r].as_py(), np.int32)
            sums.add(np.repeat(s["words"], s["sizes"]), what.astype(np.intp), often.astype(np.int64))
    sums.settle()
    label = np.zeros(len(sums.words), np.int64)
    for batch in rows:
        for r in range(batch.num_rows):
            s = _read(batch, r)
            label[sums.of(s["words"])] = s["labels"]
    best = moved(sums.sums, label, table).astype(np.uint8)
    for batch in rows:
        back = [best[sums.of(np.frombuffer(x.as_py(), np.int64))].tobytes() for x in batch.column("words")]
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("places"), pa.array(back, pa.binary())], names=["segment", "places", "labels"])
