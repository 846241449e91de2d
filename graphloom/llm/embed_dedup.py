"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that the leading dimensions
carry the most variance.  Tiles of vectors are compared on the leading
dimensions first; the product of the rest is at most the product of the
suffix norms (Cauchy-Schwarz), so a pair stops as soon as its partial product
plus that bound is below the threshold.  What reaches the end is decided on
the vectors as given, in double precision.

Vectors are dealt to cells of a tree over the leading dimensions, and cells
into blocks of bounded size.  Two unit vectors of cosine c are sqrt(2 - 2c)
apart at most, so only blocks of cells whose boxes come that near are compared.
Blocks in the order of their cells make bands, and a tile is a pair of bands: a
block is sent once for each band that is near, not for each block.  Equal
vectors are one row with a multiplicity.  A tile returns counts and the edges
of a spanning forest, never its pairs.

Vectors travel in single precision if that is how they came.  Partial products
are in single precision, with a margin for its rounding; what they leave open is
decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._io import ship, tidy
from graphloom.llm._text import mix
from graphloom.operators.components import connected_components
from graphloom.plans.lineage import scratch, written

THRESHOLD = 0.9
#: Vectors of a dimension that the turning and the tree are fitted on, about; both only change the work, not the result.
SAMPLE = 20_000
#: ... and their components, over all dimensions.
SAMPLE_VALUES = 4_000_000
#: Values of all turnings; dimensions beyond, and beyond this root, aren't turned.
TURNING_VALUES = 4_000_000
#: Cells of the trees, besides one for each dimension.
MAX_CELLS = 1024
#: Vectors in a block, about, and their components.
BLOCK = 1024
BLOCK_VALUES = 1 << 18
#: Blocks in a band, at most.
MOST_BAND = 32
#: Rows of a tile that are compared at once.
ROWS = 256
#: Dimensions after which the bound is tested.
STEPS = (8, 16, 32)
#: Share of pairs left above which a tile goes on with matrix products.
DENSE = 0.05
#: Room for rounding of boxes.
MARGIN = 1e-6
#: Room for rounding of a product of unit vectors in single precision, for each dimension, and at least.
ROUNDING, LEAST_ROUNDING = 2.4e-7, 1e-5


# --- vectors --------------------------------------------------------------------


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None]]:
    """(place, vector in double precision, or None if it can't link)."""
    values = column.values if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().values
    flat = values.cast(pa.float64())
    bad = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    data = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        low, high = int(offsets[i]), int(offsets[i + 1])
        x = data[low:high]
        if not there[i] or high == low or (bad is not None and bad[low:high].any()) or not np.isfinite(x).all() or not x.any():
            yield i, None
        else:
            yield i, x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def component_type(df: DataFrame, vector_col: str) -> type:
    """What vectors travel as: single precision only if the table has no more."""
    kind = df.schema[vector_col].dataType
    return np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims, hash_a, hash_b, vector (its components as binary); the last four are null for a vector that links with nothing."""
    ship(df.sparkSession)
    kind = component_type(df, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, a, b, raw = [], [], [], []
            for _, x in _rows(batch.column(1)):
                if x is None:
                    for out in (dims, a, b, raw):
                        out.append(None)
                    continue
                own = x + 0.0  # -0 and 0 are equal
                bits = own.view(np.uint64)
                place = mix(np.arange(1, len(bits) + 1, dtype=np.uint64))
                dims.append(len(own))
                a.append(int(mix(bits ^ place).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix(mix(bits) + place).sum(dtype=np.uint64).view(np.int64)))
                raw.append(own.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(raw, pa.binary())],
                names=["vec_id", "dims", "hash_a", "hash_b", "vector"],
            )

    chosen = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(tidy(run), "vec_id bigint, dims int, hash_a bigint, hash_b bigint, vector binary")


# --- cells ----------------------------------------------------------------------


class Cells:
    """The turning to principal axes, and a tree of median cuts along the leading ones."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        turned = sample.T @ sample
        order, axes = np.linalg.eigh(turned)
        self.axes = axes[:, np.argsort(-order)]
        points = sample @ self.axes
        self.cuts: list[tuple[int, float]] = []  # a heap: node i has children 2i + 1 and 2i + 2
        self.depth = max(0, (leaves - 1).bit_length())
        groups = [points]
        for _ in range(self.depth):
            below = []
            for own in groups:
                axis = int(np.argmax(own[:, : STEPS[0]].var(axis=0))) if len(own) > 1 else 0
                cut = float(np.median(own[:, axis])) if len(own) else 0.0
                self.cuts.append((axis, cut))
                left = own[:, axis] < cut
                below += [own[left], own[~left]]
            groups = below

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        if self.cuts:
            axis = np.array([a for a, _ in self.cuts])
            cut = np.array([c for _, c in self.cuts])
            for _ in range(self.depth):
                right = points[np.arange(len(points)), axis[node]] >= cut[node]
                node = 2 * node + 1 + right
        return node - len(self.cuts)


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, dims).astype(np.float64)


# --- tiles ----------------------------------------------------------------------


class Side:
    """A block in a tile: unit vectors as given, and turned in single precision with the norms of what follows each step."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, raw: np.ndarray, axes: np.ndarray | None) -> None:
        self.ids, self.weight = ids, weight
        self.unit = _unit(raw)
        turned = self.unit if axes is None else self.unit @ axes
        squares = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.steps = [s for s in STEPS if s < raw.shape[1]]
        self.rest = [np.sqrt(squares[:, s]).astype(np.float32) for s in self.steps]
        self.turned = turned.astype(np.float32)
        self.margin = max(LEAST_ROUNDING, ROUNDING * raw.shape[1])


def compare(a: Side, b: Side, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's vectors, of b's, and edges as places in a and in b).

    Links count the other vector's multiplicity.  With ``same`` b is a: pairs
    are taken once and vectors aren't paired with themselves.  The edges span
    the components that the tile's links make.
    """
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    label = np.arange(len(a.ids) + len(b.ids)) if not same else np.arange(len(a.ids))
    shift = 0 if same else len(a.ids)
    edges_a, edges_b = [], []
    for low in range(0, len(a.ids), ROWS):
        high = min(low + ROWS, len(a.ids))
        begin = low if same else 0
        i, j = _pairs(a, b, low, high, begin, threshold)
        if same:
            after = j > i
            i, j = i[after], j[after]
        if not len(i):
            continue
        na += np.bincount(i, weights=b.weight[j], minlength=len(na)).astype(np.int64)
        nb += np.bincount(j, weights=a.weight[i], minlength=len(nb)).astype(np.int64)
        keep = _spanning(label, i, j + shift)
        edges_a.append(i[keep])
        edges_b.append(j[keep])
    if same:
        na += nb
        nb[:] = 0
    none = np.zeros(0, np.int64)
    return na, nb, np.concatenate(edges_a or [none]), np.concatenate(edges_b or [none])


def _pairs(a: Side, b: Side, low: int, high: int, begin: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of a's rows low..high and b's from ``begin`` on."""
    x, y = a.turned[low:high], b.turned[begin:]
    part = np.zeros((high - low, len(y)), dtype=np.float32)
    floor = np.float32(threshold - a.margin)
    done = 0
    for k, step in enumerate(a.steps):
        part += x[:, done:step] @ y[:, done:step].T
        done = step
        left = part >= floor - np.outer(a.rest[k][low:high], b.rest[k][begin:])
        count = int(np.count_nonzero(left))
        if count <= DENSE * left.size:
            i, j = np.nonzero(left)
            return _decided(a, b, i + low, j + begin, threshold)
    part += x[:, done:] @ y[:, done:].T
    i, j = np.nonzero(part >= floor)
    near = part[i, j] < threshold + a.margin
    sure = ~near
    late = _decided(a, b, i[near] + low, j[near] + begin, threshold)
    return np.concatenate([i[sure] + low, late[0]]), np.concatenate([j[sure] + begin, late[1]])


def _decided(a: Side, b: Side, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    keep = np.zeros(len(i), dtype=bool)
    for low in range(0, len(i), 65_536):
        own = slice(low, low + 65_536)
        keep[own] = np.einsum("ij,ij->i", a.unit[i[own]], b.unit[j[own]]) >= threshold
    return i[keep], j[keep]


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of edges that join parts not joined before; ``label`` is brought up to date.

    Each round, every part takes one edge to the least part next to it; the
    parts that this joins are named by their least member.
    """
    kept = []
    there = np.arange(len(i))
    while True:
        u, v = label[i[there]], label[j[there]]
        apart = u != v
        there, u, v = there[apart], u[apart], v[apart]
        if not len(there):
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        high, low = np.maximum(u, v), np.minimum(u, v)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept.append(there[first])
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while True:
            after = to[to]
            if (after == to).all():
                break
            to = after
        label[:] = to[label]


def _linked_rows(a: Side, b: Side, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """(src, dst, links) of two blocks: a row for each linked vector with its links here, and the edges."""
    na, nb, i, j = compare(a, b, same, threshold)
    ids = [a.ids[na > 0]] if same else [a.ids[na > 0], b.ids[nb > 0]]
    links = [na[na > 0]] if same else [na[na > 0], nb[nb > 0]]
    ids, links = np.concatenate(ids), np.concatenate(links)
    src = np.concatenate([ids, a.ids[i]])
    dst = np.concatenate([ids, b.ids[j]])
    count = np.concatenate([links, np.zeros(len(i), np.int64)])
    if len(src):
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(count)], names=["src", "dst", "links"])


# --- dimensions, cells and bands ---------------------------------------------------


@dataclass
class Layout:
    """For each dimension: its turning and tree (none: one cell, not turned), its first cell and the vectors in a block."""

    cells: dict[int, Cells | None]
    first: dict[int, int]
    block: dict[int, int]

    def axes(self, dims: int) -> np.ndarray | None:
        own = self.cells[dims]
        return None if own is None else own.axes


def _layout(nodes: DataFrame, kind: type) -> Layout:
    """Fitted on a bounded sample, by a hash, of the dimensions with most vectors."""
    counts = {r.dims: r.n for r in nodes.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    order = sorted(counts, key=lambda d: (-counts[d], d))
    block = {d: max(1, min(BLOCK, BLOCK_VALUES // d)) for d in order}
    fitted, values = {}, 0
    total = sum(counts.values())
    for d in order:
        leaves = min(counts[d] // block[d], MAX_CELLS * counts[d] // total)
        if leaves > 1 and values + d * d <= TURNING_VALUES:
            values += d * d
            fitted[d] = leaves
    cells: dict[int, Cells | None] = dict.fromkeys(order)
    if fitted:
        share = {d: min(1.0, SAMPLE / counts[d], SAMPLE_VALUES / len(fitted) / d / counts[d]) for d in fitted}
        chosen = F.lit(False)
        for d, s in share.items():
            chosen = chosen | ((F.col("dims") == d) & (F.pmod(F.xxhash64("hash_a", "hash_b"), F.lit(1 << 30)) < int(s * (1 << 30))))
        sample = nodes.filter(chosen).select("dims", "hash_a", "hash_b", "vector").toPandas().sort_values(["dims", "hash_a", "hash_b"])
        for d, leaves in fitted.items():
            own = sample.vector[sample.dims == d]
            if len(own):
                cells[d] = Cells(_unit(np.stack([np.frombuffer(v, dtype=kind) for v in own]).astype(np.float64)), leaves)
    first, at = {}, 0
    for d in order:
        first[d] = at
        at += 1 if cells[d] is None else 1 << cells[d].depth
    return Layout(cells, first, block)


WIDE = STEPS[0]


def _links(nodes: DataFrame, kind: type, threshold: float) -> DataFrame:
    """(src, dst, links) over distinct vectors: each one's links, and edges that join what is linked."""
    spark = nodes.sparkSession
    layout = _layout(nodes, kind)
    held = spark.sparkContext.broadcast(layout)  # TURNING_VALUES, MAX_CELLS cuts, and numbers of dimensions

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            every = batch.column(0).to_numpy()
            for d in np.unique(every).tolist():
                rows = batch.filter(pa.array(every == d))
                tree = own.cells[d]
                head = np.zeros((rows.num_rows, WIDE))
                cell = np.full(rows.num_rows, own.first[d])
                if tree is not None:
                    turned = _unit(_matrix(rows.column(3), d, kind)) @ tree.axes
                    cell += tree.of(turned)
                    head[:, : min(d, WIDE)] = turned[:, :WIDE]
                heads = pa.FixedSizeListArray.from_arrays(pa.array(head.ravel()), WIDE).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.int64()), heads], names=["dims", "node", "weight", "vector", "cell", "head"])

    dealt = written(
        nodes.select("dims", "node", "weight", "vector").mapInArrow(tidy(placed), "dims int, node bigint, weight bigint, vector binary, cell bigint, head array<double>"), "cells"
    )
    bounds = [f(F.col("head")[k]).alias(f"{n}{k}") for k in range(WIDE) for n, f in (("low", F.min), ("high", F.max))]
    # MAX_CELLS rows at most, and one for each dimension without a tree.
    boxes = dealt.groupBy("dims", "cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").collect()
    parts = [-(-r.n // layout.block[r.dims]) for r in boxes]
    band = int(min(MOST_BAND, max(1, np.ceil(np.sqrt(sum(parts))))))
    starts = np.cumsum([0, *parts])
    sizes = spark.createDataFrame([(r.cell, p, int(s)) for r, p, s in zip(boxes, parts, starts, strict=False)], "cell long, parts long, start long")
    blocks = written(_blocks(dealt, sizes, band), "blocks")
    return _compared(spark, blocks, sizes, _near_cells(boxes, threshold), held, band, kind, threshold)


def _near_cells(boxes: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of cells of one dimension whose boxes are within the distance of a link."""
    low = np.array([[r[f"low{k}"] for k in range(WIDE)] for r in boxes])
    high = np.array([[r[f"high{k}"] for k in range(WIDE)] for r in boxes])
    dims = np.array([r.dims for r in boxes])
    reach = 2 - 2 * threshold + MARGIN
    out = []
    for i, r in enumerate(boxes):
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        out += [(r.cell, boxes[i + int(k)].cell) for k in np.flatnonzero(((gap**2).sum(axis=1) <= reach) & (dims[i:] == r.dims))]
    return out


def _blocks(dealt: DataFrame, sizes: DataFrame, band: int) -> DataFrame:
    """band, block, cell, dims, ids, weights, vectors: one row for each block; blocks are numbered in the order of cells."""
    own = dealt.join(F.broadcast(sizes), "cell")  # a row for each cell
    keyed = own.select("cell", "dims", (F.col("start") + F.pmod(F.xxhash64("node"), "parts")).alias("block"), "node", "weight", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            *whole, rest = _groups(rest)
            for group in whole:
                yield _packed(group, band)
        if rest is not None and rest.num_rows:
            for group in _groups(rest):
                yield _packed(group, band)

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(parts, "block").sortWithinPartitions("block", "node")
    return ordered.mapInArrow(tidy(run), "band bigint, block bigint, cell bigint, dims int, ids binary, weights binary, vectors binary")


def _groups(rows: pa.Table) -> list[pa.Table]:
    block = rows.column("block").to_numpy()
    if not len(block):
        return [rows]
    new = np.flatnonzero(block[1:] != block[:-1]) + 1
    at = [0, *new.tolist(), len(block)]
    return [rows.slice(i, j - i) for i, j in zip(at, at[1:], strict=False)]


def _packed(group: pa.Table, band: int) -> pa.RecordBatch:
    group = group.combine_chunks()
    block, cell, dims = (group.column(n)[0].as_py() for n in ("block", "cell", "dims"))
    raw = [group.column(n).to_numpy().astype(np.int64).tobytes() for n in ("node", "weight")]
    data = b"".join(group.column("vector").to_pylist())
    numbers = [pa.array([x], t) for x, t in ((block // band, pa.int64()), (block, pa.int64()), (cell, pa.int64()), (dims, pa.int32()))]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x], pa.binary()) for x in (*raw, data))], names=["band", "block", "cell", "dims", "ids", "weights", "vectors"])


def _compared(spark: SparkSession, blocks: DataFrame, sizes: DataFrame, near: list[tuple[int, int]], held, band: int, kind: type, threshold: float) -> DataFrame:
    """Each pair of bands that hold near cells is a tile; a tile gets its one or two bands."""
    most = 1 + max(b for _, b in near)
    close = spark.sparkContext.broadcast(np.sort(np.array(near, dtype=np.int64) @ np.array([most, 1])))  # MAX_CELLS ** 2 / 2 pairs at most, and one for each other cell
    pairs = spark.createDataFrame(near, "left long, right long")
    # A cell lies in neighbouring bands.
    spans = sizes.select("cell", F.explode(F.sequence(F.floor(F.col("start") / band), F.floor((F.col("start") + F.col("parts") - 1) / band))).alias("band"))
    left = spans.toDF("left", "a").join(F.broadcast(pairs), "left")
    met = left.join(spans.toDF("right", "b"), "right").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tiles = written(met.select(F.xxhash64("a", "b").alias("tile"), "a", "b"), "tiles")
    count = max(1, tiles.count())
    # Places: 0 on the left of two bands, 1 on the right, 2 in a band that meets itself.
    wanted = tiles.select("tile", F.col("a").alias("band"), F.expr("if(a = b, 2, 0)").alias("place")).union(tiles.filter("a <> b").select("tile", "b", F.lit(1)))
    sent = wanted.join(blocks, "band").select("tile", "place", "block", "cell", "dims", "ids", "weights", "vectors")

    def side(row: dict) -> Side:
        raw = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["dims"]).astype(np.float64)
        return Side(np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["weights"], dtype=np.int64), raw, held.value.axes(row["dims"]))

    def is_near(x: int, y: int) -> bool:
        code = min(x, y) * most + max(x, y)
        at = int(np.searchsorted(close.value, code))
        return at < len(close.value) and int(close.value[at]) == code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The left band's blocks come first and are held; then each block of the right one meets them."""
        tile, first = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                if row["tile"] != tile:
                    tile, first = row["tile"], []
                own = (row["block"], row["cell"], side(row))
                if row["place"] != 1:
                    first.append(own)
                for block, cell, other in first if row["place"] else ():
                    if is_near(cell, own[1]):
                        yield from _linked_rows(other, own[2], block == own[0], threshold)

    parts = min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    ordered = sent.repartition(parts, "tile").sortWithinPartitions("tile", "place", "block")
    return ordered.mapInArrow(tidy(run), "src bigint, dst bigint, links bigint")


# --- the operator -----------------------------------------------------------------


def embedding_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimension.  Repeated rows
    of an id count as copies of its vector.  Rows with a null id take no part:
    they have no links, a null component, and are kept.  An empty table gives an
    empty result.  Other columns are not read.  ``threshold`` lies above 0.
    """
    spark = df.sparkSession
    with scratch(spark) as kept:
        every = written(vectors(df, id_col, vector_col), "vectors")
        able = every.filter("vector is not null and vec_id is not null")
        nodes = written(
            able.groupBy("dims", "hash_a", "hash_b").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector")),
            "distinct",
        )
        if nodes.isEmpty():
            found = spark.createDataFrame([], "src long, dst long, links long")
        else:
            found = written(_links(nodes, component_type(df, vector_col), threshold), "links")
        counted = found.filter("links > 0").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
        labels = connected_components(found.filter("src <> dst"), "src", "dst")
        classes = nodes.select("dims", "hash_a", "hash_b", "node", "weight").join(counted, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
        joined = every.drop("vector").join(classes, ["dims", "hash_a", "hash_b"], "left")
        out = joined.select(
            "vec_id",
            F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "node", "vec_id")).alias("component_id"),
        )
        return kept(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "embedding_duplicates")
