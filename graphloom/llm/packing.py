"""Packing by patterns of few documents, fitted by non-negative least squares.

Documents become pieces of at most ``limit`` tokens.  Patterns of one to three
length classes that fill a sequence are enumerated; how often each is used is
fitted to the histogram of lengths by non-negative least squares and rounded
down; the residual pieces are packed best-fit, longest first, into the room
that is left and into new sequences.

The plan is made on the histogram alone, which has ``limit`` entries however
many documents there are.  It says: pieces of length l with ranks from r on,
c of them, go to sequences s, s + 1, ... at offset o.  Each piece then finds
its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm._io import ship, tidy
from graphloom.llm._text import slices, utf8
from graphloom.plans.lineage import written

LIMIT = 2048
#: Length classes in a sequence; a class is limit / CLASSES tokens wide.
CLASSES = 256
#: Pieces whose ranks are counted together.
CHUNK = 100_000
END = 0


# --- pieces --------------------------------------------------------------------


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, chunk, local and, if asked for, ids.

    A document's ids are its text's and ``END``.  A document longer than
    ``limit`` is cut from its end into full pieces; the first takes the rest.
    ``local`` counts pieces of the same length within a chunk.  Null texts are
    empty; repeated rows are packed repeatedly.
    """
    ship(df.sparkSession)
    path = tokenizer or bpe.default_path()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk bigint, local bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        counted = _Ranks(TaskContext.get().partitionId(), limit)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 2_000_000):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield _cut(part.column(0).to_pylist(), encode.encode(texts), limit, counted, with_ids)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


class _Ranks:
    """Ranks among equal lengths, in chunks numbered apart for each task."""

    def __init__(self, task: int, limit: int) -> None:
        self.chunk, self.limit = task << 32, limit
        self._clear()

    def _clear(self) -> None:
        self.counts, self.n = [0] * (self.limit + 1), 0

    def next(self, length: int) -> tuple[int, int]:
        if self.n == CHUNK:
            self.chunk += 1
            self._clear()
        self.n += 1
        rank = self.counts[length]
        self.counts[length] += 1
        return self.chunk, rank


def _cut(doc_ids: list, encoded: list[bytes], limit: int, ranks: _Ranks, with_ids: bool) -> pa.RecordBatch:
    rows: list[tuple] = []
    ids = []
    tail = END.to_bytes(4, "little")
    for doc_id, data in zip(doc_ids, encoded, strict=True):
        data += tail
        total = len(data) // 4
        start, piece = 0, 0
        stop = total % limit or min(total, limit)
        while start < total:
            own = memoryview(data)[4 * start : 4 * stop]
            rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), *ranks.next(stop - start)))
            if with_ids:
                ids.append(np.frombuffer(own, dtype="<i4"))
            start, stop, piece = stop, stop + limit, piece + 1
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "local"]
    if with_ids:
        arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


# --- plan ----------------------------------------------------------------------


def patterns(classes: int) -> np.ndarray:
    """Rows of up to three classes, in falling order, that add up to ``classes``; 0 is none."""
    out = [(classes, 0, 0)]
    out += [(classes - b, b, 0) for b in range(1, classes // 2 + 1)]
    out += [(classes - b - c, b, c) for c in range(1, classes // 3 + 1) for b in range(c, (classes - c) // 2 + 1)]
    return np.array(out)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes the sum of squares of A x - target least (active sets).

    Column j of A counts the entries of ``columns[j]``; entry 0 is none.
    """
    n = len(target)

    def counts(own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), n + 1))
        for part in columns[own].T:
            np.add.at(out, (np.arange(len(own)), part), 1.0)
        return out[:, 1:]

    x = np.zeros(len(columns))
    active = np.zeros(len(columns), dtype=bool)
    rest = target.astype(float)
    tolerance = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = np.concatenate([[0.0], rest])[columns].sum(axis=1)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if not gain[j] > tolerance:
            break
        active[j] = True
        while True:
            own = np.flatnonzero(active)
            part = counts(own)
            solved = np.linalg.solve(part @ part.T + 1e-9 * np.eye(len(own)), part @ target)
            if (solved > 0).all():
                x[:] = 0
                x[own] = solved
                break
            back = solved <= 0
            step = np.min(x[own][back] / np.maximum(x[own][back] - solved[back], 1e-300))
            x[own] += step * (solved - x[own])
            gone = own[back & (x[own] <= 1e-12)]
            if not len(gone):
                gone = own[back][[int(np.argmin(x[own][back]))]]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
        own = np.flatnonzero(active)
        rest = target - x[own] @ counts(own)
    return x


class Plan:
    """Placements (length, first rank, count, first sequence, offset), and the number of sequences."""

    def __init__(self, placements: list[tuple[int, int, int, int, int]], n_sequences: int, limit: int) -> None:
        self.n_sequences = n_sequences
        rows = np.array(sorted(placements), dtype=np.int64).reshape(-1, 5)
        self.key = rows[:, 0] << 44 | rows[:, 1]
        self.first, self.sequence, self.offset = rows[:, 1], rows[:, 3], rows[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def make_plan(histogram: dict[int, int], limit: int = LIMIT, classes: int = CLASSES) -> Plan:
    """A plan for so many pieces of each length; lengths are 1 to ``limit``."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(limit + 1, dtype=np.int64)
    placements: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}  # tokens left -> [(first sequence, count)]

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        placements.append((length, int(used[length]), count, sequence, offset))
        used[length] += count
        left[length] -= count

    # Full pieces fill their sequences.
    if left[limit]:
        n = int(left[limit])
        put(limit, n, 0, 0)
        sequences = n
    width = max(1, limit // classes)
    top = limit // width
    of_class = (np.arange(limit + 1) + width - 1) // width
    target = np.bincount(of_class[1:], weights=left[1:], minlength=top + 1)[1 : top + 1]
    shapes = patterns(top)
    fitted = np.floor(nnls(shapes, target) + 1e-6).astype(int)
    members = [np.flatnonzero(of_class == c)[::-1] for c in range(top + 1)]
    for p in np.argsort(-shapes[:, 0], kind="stable"):
        count = int(fitted[p])
        shape = [int(c) for c in shapes[p] if c]
        # The longest of the first class go with the shortest of the others.
        while count > 0:
            chosen: list[int] = []
            for k, c in enumerate(shape):
                options = members[c] if k == 0 else members[c][::-1]
                own = next((int(m) for m in options if left[m] > chosen.count(int(m)) and m <= limit), None)
                if own is None:
                    break
                chosen.append(own)
            if len(chosen) < len(shape):
                break
            n = min([count, *(int(left[m]) // chosen.count(m) for m in set(chosen))])
            offset = 0
            for m in chosen:
                put(m, n, sequences, offset)
                offset += m
            if limit - offset:
                room.setdefault(limit - offset, []).append((sequences, n))
            sequences += n
            count -= n
    # Best fit, longest first, on runs of equal lengths.
    for length in range(limit, 0, -1):
        while left[length]:
            best = min((r for r in room if r >= length), default=None)
            if best is None:
                fits = limit // length
                n = -(-int(left[length]) // fits)
                room[limit] = [(sequences, n)]
                sequences += n
                best = limit
            first, count = room[best].pop()
            if not room[best]:
                del room[best]
            n = min(count, int(left[length]))
            put(length, n, first, limit - best)
            if n < count:
                room.setdefault(best, []).append((first + n, count - n))
            if best > length:
                room.setdefault(best - length, []).append((first, n))
    return Plan(placements, sequences, limit)


# --- packing -------------------------------------------------------------------


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    A null or empty text is one piece of the end alone; a null id is kept;
    repeated rows are packed repeatedly; an empty input gives an empty result.
    Other columns are not read.
    """
    spark = df.sparkSession
    cut = written(pieces(df, id_col, text_col, limit, tokenizer, with_ids), "pieces")
    counts = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    # A length has a row for each chunk of many pieces here, not for each piece.
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    plan = spark.sparkContext.broadcast(make_plan(histogram, limit))  # bounded by the number of lengths
    more = ["ids"] if with_ids else []
    ranked = cut.join(first, ["chunk", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *more, (F.col("base") + F.col("local")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = own.place(length, rank)
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", *more)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *more, "sequence_id", "offset"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(tidy(run), schema)
