"""Near-duplicates by a multi-index Hamming join on b-bit MinHash signatures.

A document's signature has ``HASHES`` min-hash values of ``BITS`` bits.  It is
split into ``CHUNKS`` chunks.  By the pigeonhole principle two signatures that
differ in at most ``RADIUS`` values have a chunk in which they differ in at
most ``ERRORS``; every way to leave out so many values of a chunk gives a key,
so all pairs within that distance share a key.  (Pairs farther apart may share
one too: at a similarity of 0.75 the chance that none of the keys agrees is
about one in a million.)

Documents that share a key are a bucket.  Candidates are confirmed on the full
shingle sets.  No bucket is expanded into its pairs: first every member is
compared with the least member of its star, a bounded part of the bucket, and
the stars' least members in stars of their own, which settles groups of copies.
Then, in buckets whose members are still in different components, those outside
the largest component are compared with all others, in tiles of bounded size
and of sets whose sizes allow a link, on signatures, and only the survivors of
that on full sets.  Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._io import fresh, ship, tidy
from graphloom.llm._text import Words, mix, shingle_sets, slices, utf8
from graphloom.operators.components import connected_components
from graphloom.plans.lineage import scratch, written

HASHES = 40
BITS = 16
CHUNKS = 10
ERRORS = 1
#: Every pair of signatures that differ in at most so many values shares a key.
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Candidates that differ in more values aren't compared on full sets.  At a
#: similarity of 0.75 values differ with a chance of a quarter, so 25 of 40 are
#: exceeded about twice in a million.
LOOSE = 24
WIDTH = 5
#: Links: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Members of a bucket that are compared with one pivot, about; a power of two.
STAR = 256
#: Members of a bucket that one tile holds on a side, about.
TILE = 512
#: Sets are graded by the logarithm of their size to this base: linked ones differ by one
#: grade at most, since it is more than 100 / SIMILARITY.
GRADE = 1.34
#: Bins of a one-permutation sketch, which tells similar from nearly similar
#: documents in a tile: a shingle's bin is its hash's first bits.
BINS = 256
#: A pair is left out if it agrees in so many standard deviations fewer bins than a linked pair does.
DEVIATIONS = 5.5

_SEED = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_FACTOR = mix(_SEED) | np.uint64(1)
_LOW = np.uint64((1 << BITS) - 1)


# --- signatures ------------------------------------------------------------------


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, two hashes of the whole set) of the documents that have shingles."""
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.zeros((len(first), HASHES), dtype=np.uint16)
    if not len(first):
        return out, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for k in range(HASHES):
        least = np.minimum.reduceat((values ^ _SEED[k]) * _FACTOR[k], first)
        out[:, k] = mix(least) & _LOW
    return out, np.add.reduceat(mix(values), first), np.add.reduceat(mix(values ^ np.uint64(0x6A09E667F3BCC909)), first)


def _sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document with shingles and each bin, 15 bits of its least shingle there; 0 if there is none."""
    size = np.diff(bounds)
    there = size > 0
    owner = np.repeat(np.arange(int(there.sum())), size[there])
    slot = owner * BINS + (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    out = np.zeros((int(there.sum()), BINS), dtype=np.uint16)
    out.ravel()[slot[first]] = (mix(values[first]) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, signature, sketch; the last four are null for a document without words."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                values, bounds = shingle_sets(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), WIDTH)
                size = np.diff(bounds)
                there = size > 0
                signature, a, b = _signatures(values, bounds)
                at = np.cumsum(there) - 1
                place = pa.array(at, mask=~there)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(size, pa.int64()),
                        pa.array(a.view(np.int64)).take(place),
                        pa.array(b.view(np.int64)).take(place),
                        _binary(signature).take(place),
                        _binary(_sketches(values, bounds)).take(place),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "sketch"],
                )

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, sketch binary")


def _binary(rows: np.ndarray) -> pa.Array:
    wide = pa.binary(rows.shape[1] * rows.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(wide, len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, wide: int = HASHES) -> np.ndarray:
    """Signatures or sketches as rows; no value may be null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, _ = _raw(column)
    return data.view(np.uint16).reshape(-1, wide)


def _alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which sketches agree with one in about as many bins as those of linked documents do.

    Of the bins that either fills, as large a share agrees as the documents
    are similar, with at most the spread of as many independent draws.
    """
    filled = ((sketches > 0) | (one > 0)).sum(axis=1)
    agree = ((sketches == one) & (one > 0)).sum(axis=1)
    share = SIMILARITY / 100
    return agree >= share * filled - DEVIATIONS * np.sqrt(share * (1 - share) * filled)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """One column for each chunk and each choice of ``ERRORS`` values to leave out."""
    wide = HASHES // CHUNKS
    columns = []
    for c in range(CHUNKS):
        own = signature[:, c * wide : (c + 1) * wide].astype(np.uint64)
        for kept in combinations(range(wide), wide - ERRORS):
            key = np.full(len(own), len(columns) + 1, dtype=np.uint64)
            for i in kept:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, i])
            columns.append(key)
    return np.stack(columns, axis=1)


def _keys(nodes: DataFrame) -> DataFrame:
    """key, node, grade: all keys of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_matrix(batch.column(1)))
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                size = batch.column(2).to_numpy(zero_copy_only=False)
                grade = np.repeat(np.floor(np.log(np.maximum(size, 1)) / np.log(GRADE)).astype(np.int32), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(grade)], names=["key", "node", "grade"])

    return nodes.select("node", "signature", "n_shingles").mapInArrow(tidy(run), "key bigint, node bigint, grade int")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b): each member and the least member b of its star, then those least
    members in stars of their own, and so on up to the bucket's least member.

    A node falls into the same part of all buckets of about one size, so that
    copies, which share many buckets, meet few different pivots.
    """
    most = buckets.agg(F.max("size")).first()[0] or 0
    small = buckets.filter(F.col("size") <= STAR).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    out = [small]
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") / F.lit(float(STAR))))).cast("long")
    rows = buckets.filter(F.col("size") > STAR).select("key", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    last = most <= STAR
    while not last:
        last = most <= STAR  # then every bucket is one part
        least = F.min("node").over(Window.partitionBy("key", "part"))
        out.append(rows.select(F.col("node").alias("a"), least.alias("b")))
        fewer = F.greatest(F.lit(1).cast("long"), F.floor(F.col("parts") / STAR).cast("long"))
        heads = rows.groupBy("key", "part").agg(F.min("node").alias("node"), F.min("parts").alias("parts"))
        rows = heads.select("key", "node", fewer.alias("parts"), F.pmod("part", fewer).alias("part"))
        most = -(-2 * most // STAR)  # rounded up to a power of two
    return reduce(DataFrame.union, out).filter("a <> b").distinct()


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``LOOSE`` values."""
    own = nodes.select("node", "n_shingles", "signature")
    both = (
        pairs.join(own.toDF("a", "na", "sa"), "a")
        .join(own.toDF("b", "nb", "sb"), "b")
        .filter(f"100 * least(na, nb) >= {SIMILARITY} * greatest(na, nb)")
        .select("a", "b", "sa", "sb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(differ <= LOOSE))

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


# --- confirmation -----------------------------------------------------------------


def _sieve(pairs: DataFrame) -> tuple[int, np.ndarray]:
    """A bit table of the ids in ``pairs``: (log2 of its bits, 64-bit words).

    It has 32 bits for each id up to 2**27 bits (16 MB) in all, whatever the
    input; with more ids it lets more other ids pass, never fewer.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    n = max(1, pairs.count())
    log = min(27, max(16, (64 * n - 1).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << log))
    words = ids.select(bit.alias("bit")).selectExpr("cast(floor(bit / 64) as int) as w", "shiftleft(1L, cast(pmod(bit, 64) as int)) as v")
    table = np.zeros((1 << log) // 64, dtype=np.int64)
    rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    table[rows.w.to_numpy()] = rows.v.to_numpy()
    return log, table


def _texts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of about the documents in ``pairs``: whole texts are only shuffled for these."""
    log, table = _sieve(pairs)
    held = documents.sparkSession.sparkContext.broadcast(table)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            there = (words[bit // 64] >> (bit % 64)) & 1
            yield batch.select([0, 1]).filter(pa.array(there.astype(bool)))

    chosen = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return chosen.withColumn("bit", F.pmod(F.xxhash64("node"), F.lit(1 << log))).mapInArrow(tidy(run), "node bigint, text string")


def _confirmed(pairs: DataFrame, documents: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) that link on full shingle sets.

    A pivot's text is sent once, to where its star's texts go; no pair carries
    two texts.  An id with several texts links if one of them does.
    """
    texts = _texts(documents, pairs)
    if repeated:
        texts = texts.distinct()  # a row that is repeated very often is compared once
    needed = pairs.select(F.col("a").alias("node"), "b").union(pairs.select(F.col("b").alias("node"), "b").distinct())
    rows = needed.join(texts, "node").select("b", "node", (F.col("node") != F.col("b")).alias("member"), "text")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, []
        for batch in batches:
            _, offsets = utf8(batch.column(3))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                values, bounds = _sets(part.column(3))
                linked = np.zeros(part.num_rows, dtype=bool)
                b, member = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                for r in range(part.num_rows):
                    own = values[bounds[r] : bounds[r + 1]]
                    if b[r] != pivot:
                        pivot, held = b[r], []
                    if member[r]:
                        linked[r] = any(_linked_sets(own, x) for x in held)
                    else:
                        held.append(own.copy())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0)], names=["a", "b"]).filter(pa.array(linked))

    return rows.repartition(parts, "b").sortWithinPartitions("b", "member").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _linked_sets(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link; an empty one links with nothing."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < SIMILARITY * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    return shingle_sets(Words(data, offsets), WIDTH)


# --- what is left in buckets --------------------------------------------------------


TILED = "tile bigint, key bigint, left boolean, right boolean, node bigint, label bigint, n_shingles bigint, signature binary, sketch binary"


def _tiles(buckets: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``TILED``: members of a tile that are near a member of another component.

    Buckets of one component, and buckets of two members (already compared),
    are left out.  In the others only members outside the bucket's largest
    component, its minor members, look for others: a bucket with few of them
    makes few rows, however large it is.  A bucket of more than ``TILE``
    members is dealt into blocks by grade, minor or not, and a hash; a tile
    is a block of minor members and another block of a grade that allows links.
    Members are returned, never pairs.
    """
    labelled = buckets.join(labels, buckets.node == labels.id, "left").select("key", "node", "grade", "size", F.coalesce("component", "node").alias("label"))
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("of")).filter("labels > 1 and of > 2")
    rows = labelled.join(mixed.select("key", F.col("most.label").alias("major")), "key").withColumn("minor", F.col("label") != F.col("major"))
    rows = written(rows.select("key", "node", "grade", "size", "label", "minor"), "mixed")
    small = rows.filter(F.col("size") <= TILE).select(F.xxhash64("key").alias("tile"), "key", F.col("minor").alias("left"), F.lit(True).alias("right"), "node", "label")
    tiled = small.union(_dealt(rows.filter(F.col("size") > TILE))).join(nodes.select("node", "n_shingles", "signature", "sketch"), "node")

    def near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        members = np.zeros(rows.num_rows, dtype=bool)
        for i, others in _near_members(rows):
            members[i] = True
            members[others] = True
        if members.any():
            yield from rows.filter(pa.array(members)).combine_chunks().to_batches()

    return _by_tile(tiled.select(*(c.split()[0] for c in TILED.split(", ")))).mapInArrow(tidy(_each_tile(near)), TILED)


def _dealt(rows: DataFrame) -> DataFrame:
    """tile, key, left, right, node, label of large buckets: each member once for each tile of its block."""
    kind = ["key", "grade", "minor"]
    parts = rows.groupBy(*kind).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    blocks = parts.select(*kind, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = blocks.filter("minor").select("key", F.col("grade").alias("g"), F.col("part").alias("p"))
    right = blocks.select("key", F.col("grade").alias("h"), F.col("minor").alias("m"), F.col("part").alias("q"))
    # Pairs of blocks, not of members; two minor blocks meet once.
    tiles = left.join(right, "key").filter("abs(g - h) <= 1 and (not m or h > g or (h = g and q >= p))")
    tiles = tiles.withColumn("tile", F.xxhash64("key", "g", "p", "h", "m", "q")).withColumn("own", F.expr("m and h = g and p = q"))
    sides = tiles.select("tile", "key", F.col("g").alias("grade"), F.lit(True).alias("minor"), F.col("p").alias("part"), F.lit(True).alias("left"), F.col("own").alias("right")).union(
        tiles.filter("not own").select("tile", "key", F.col("h").alias("grade"), F.col("m").alias("minor"), F.col("q").alias("part"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    )
    members = rows.join(parts, kind).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return members.join(sides, [*kind, "part"]).select("tile", "key", "left", "right", "node", "label")


def _late_links(tiled: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of a tile, found on full shingle sets."""
    ids = tiled.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    texts = _texts(documents, ids)
    whole = tiled.join(texts.withColumnRenamed("node", "id"), F.col("node") == F.col("id")).drop("id")

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs = _joining(rows)
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_tile(whole).mapInArrow(tidy(_each_tile(links)), "a bigint, b bigint").distinct()


def _by_tile(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tile").sortWithinPartitions("tile", "key")


def _each_tile(work):
    """Apply ``work`` to the rows of one tile after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            tile, key = rows.column("tile").to_numpy(), rows.column("key").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (key[1:] != key[:-1])]))
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield from work(rows.slice(low, high - low).combine_chunks())
            rest = rows.slice(int(first[-1]))
        if rest is not None and rest.num_rows:
            yield from work(rest.combine_chunks())

    return run


def _near_members(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places of the members it is near to); each pair of a bucket once.

    A pair is taken in the bucket of the first key it shares only, whatever
    other buckets hold it.
    """
    node, label, size = (rows.column(n).to_numpy() for n in ("node", "label", "n_shingles"))
    left, right = (rows.column(n).to_numpy() for n in ("left", "right"))
    signature, sketch = _matrix(rows.column("signature")), _matrix(rows.column("sketch"), BINS)
    keys = chunk_keys(signature).view(np.int64)
    here = int(rows.column("key")[0].as_py())
    right_of = np.flatnonzero(right)
    for i in np.flatnonzero(left).tolist():
        others = right_of[label[right_of] != label[i]]
        others = others[(node[others] > node[i]) | ~left[others]]
        others = others[100 * np.minimum(size[others], size[i]) >= SIMILARITY * np.maximum(size[others], size[i])]
        if len(others):
            others = others[(signature[others] != signature[i]).sum(axis=1) <= LOOSE]
        if len(others):
            others = others[_alike(sketch[others], sketch[i])]
        if len(others):
            shared = keys[others] == keys[i]
            others = others[keys[i][shared.argmax(axis=1)] == here]
        if len(others):
            yield i, others


def _joining(rows: pa.Table) -> list[tuple[int, int]]:
    """Linked pairs (higher id, lower id) of different components, as few as join them."""
    values, bounds = _sets(rows.column("text"))
    node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    out = []
    for i, others in _near_members(rows):
        for j in others.tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b and _linked_sets(values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]]):
                joined[max(a, b)] = min(a, b)
                out.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
    return out


# --- the operator -------------------------------------------------------------------


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Null texts and texts without words have no shingles and link with nothing.
    Rows of one id are one document: if their texts differ, each row has its own
    ``n_shingles``, and what links with one of the texts is in the component
    of all.  Rows with a null id take no part: their component is null and
    they are kept.  An empty input gives an empty result.  Other columns are
    not read.
    """
    with scratch(documents.sparkSession) as kept:
        every = written(signatures(documents), "signatures")
        known = every.filter("set_a is not null and doc_id is not null")
        # A class of equal sets is named by its least id.  Two classes may have one name: that id has both texts.
        classes = written(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "classes")
        repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
        labels = _linked(documents, _nodes(every, classes), _own_links(known, classes) if repeated else None)
        found = (
            every.join(classes, ["set_a", "set_b"], "left")
            .join(labels, F.col("node") == F.col("id"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
        )
        if repeated:
            # An id with words in one row only, or with several texts, has one component.
            whole = found.filter("doc_id is not null and component is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min("component").alias("all"))
            found = found.join(whole, F.col("doc_id") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("component", "all").alias("component"))
        out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        return kept(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near_duplicates")


def _own_links(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that an id's texts are in."""
    named = known.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "node")
    least = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("doc_id", "b")
    return named.join(least, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _nodes(every: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n_shingles, signature, sketch: a row for each distinct set."""
    chosen = every.filter("set_a is not null").select(F.col("doc_id").alias("node"), "set_a", "set_b", "n_shingles", "signature", "sketch")
    one = chosen.join(classes, ["node", "set_a", "set_b"], "left_semi").dropDuplicates(["node", "set_a", "set_b"])
    return written(one.select("node", "n_shingles", "signature", "sketch"), "nodes")


def _linked(documents: DataFrame, nodes: DataFrame, own: DataFrame | None) -> DataFrame:
    """(id, component) of nodes with a link; ``own`` are links that are known already."""
    keys = _keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("size")).filter("pivot <> last")
    buckets = written(keys.join(shared.select("key", "pivot", "size"), "key").distinct(), "buckets")
    first = written(_near(_stars(buckets), nodes).distinct(), "candidates")
    links = _confirmed(first, documents, own is not None)
    links = written(links if own is None else links.union(own), "links")
    labels = written(connected_components(links, "a", "b"), "labels")
    rest = written(_tiles(buckets, labels, nodes), "tiles")
    if rest.isEmpty():
        return labels
    late = written(_late_links(rest, documents), "links")
    if late.isEmpty():
        return labels
    # Links between components: join the components, not their members.
    named = labels.select("id", "component")
    between = (
        late.join(named.toDF("a", "ca"), "a", "left")
        .join(named.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    joined = written(connected_components(between, "a", "b"), "labels").toDF("component", "whole")
    moved = labels.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("component").alias("id"), F.col("whole").alias("component")).join(labels.select("id"), "id", "left_anti")
    return written(moved.union(alone), "labels")


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, all its columns, whatever their names.

    The one of the least id stays; of repeated rows of an id, the first by text
    (nulls first), then by the other columns that have an order.  Documents
    without words and rows with a null id stay.  An empty input gives an empty result.
    """
    kept = near_duplicates(documents).filter("kept and doc_id is not null").select("doc_id").distinct()
    others = [F.col(f"`{f.name}`") for f in documents.schema if f.name not in ("doc_id", "text") and _ordered(f.dataType)]
    place = Window.partitionBy("doc_id").orderBy("text", *others)
    name = fresh("place", documents.columns)
    known = documents.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = known.withColumn(name, F.row_number().over(place)).filter(F.col(name) == 1).drop(name)
    return one.select(*documents.columns).union(documents.filter("doc_id is null"))


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))
