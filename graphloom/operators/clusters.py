"""Clusters of node vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import written

#: Points up to which the spanning tree is built in one task; for more it is built in shares.
MOST_POINTS = 20_000
#: Tasks that share the points; each gets all vectors.
SHARES = 12
#: Neighbours of a point that are known at once, at least.
NEAR = 16
#: Distances that a task holds at once.
HELD = 1 << 22


def kmeans(vectors: DataFrame, k: int = 10, iterations: int = 20, seed: int = 42) -> DataFrame:
    """id, community_id, distance_from_centroid; ``vectors`` has id and vector (array of numbers).

    Lloyd's iterations run distributed; only the k centres come to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||").fit(points)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "community_id int, centre array<double>")
    found = model.transform(points).select("id", F.col("prediction").alias("community_id"), vector_to_array("features").alias("v"))
    far = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return found.join(F.broadcast(centres), "community_id").select("id", F.col("community_id").cast("long").alias("community_id"), far.alias("distance_from_centroid"))  # k rows


def hdbscan(vectors: DataFrame, min_samples: int = 5, min_cluster_size: int = 5) -> DataFrame:
    """id, cluster_id (-1 is noise), probability, outlier_score.

    The hierarchy is sequential, so it is built in one task, from a spanning
    tree: a row for each point.  The tree of more than ``MOST_POINTS`` points is
    found in shares by all their distances; it has the same weights.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    if vectors.count() > MOST_POINTS:
        return _in_shares(vectors, kind, min_samples, min_cluster_size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            own = pd.concat(parts).sort_values("id", ignore_index=True)
            label, probability, outlier = density_clusters(np.stack(own["vector"].to_numpy()), min_samples, min_cluster_size)
            yield pd.DataFrame({"id": own["id"], "cluster_id": label, "probability": probability, "outlier_score": outlier})

    chosen = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).coalesce(1)
    return chosen.mapInPandas(run, f"id {kind}, cluster_id bigint, probability double, outlier_score double")


def _spanning_tree(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Prim's tree over mutual reachability: rows of (a, b, distance) by falling closeness."""
    n = len(points)
    best = np.full(n, np.inf)
    origin = np.zeros(n, dtype=int)
    inside = np.zeros(n, dtype=bool)
    at, rows = 0, []
    for _ in range(n - 1):
        inside[at] = True
        far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        far = np.maximum(np.maximum(far, core), core[at])
        nearer = (far < best) & ~inside
        best[nearer], origin[nearer] = far[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        rows.append((origin[at], at, best[at]))
    tree = np.array(rows).reshape(-1, 3)
    return tree[np.argsort(tree[:, 2], kind="stable")]


def _to_all(df: DataFrame, shares: int) -> DataFrame:
    return df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(4 * shares, "share")


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(n, -1)


def _nearest(points: np.ndarray, rows: np.ndarray, k: int, core: np.ndarray | None, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of some points and how far they are, by mutual reach and outside their own part if given.

    Candidates follow from one product of matrices; what is kept is measured again by differences.
    """
    squares = (points * points).sum(axis=1)
    near, far = np.empty((len(rows), k), dtype=np.int64), np.empty((len(rows), k))
    step = max(1, HELD // len(points))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        d = points[own] @ points.T
        d *= -2.0
        d += squares
        d += squares[own, None]
        np.maximum(d, 0.0, out=d)
        if core is None or part is None:
            d[np.arange(len(own)), own] = np.inf
        else:
            np.maximum(d, (core * core)[None, :], out=d)
            np.maximum(d, (core[own] ** 2)[:, None], out=d)
            d[part[own][:, None] == part[None, :]] = np.inf
        found = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(k), d.shape).copy()
        exact = np.sqrt(((points[found] - points[own][:, None, :]) ** 2).sum(axis=2))
        if core is not None:
            exact = np.maximum(np.maximum(exact, core[found]), core[own][:, None])
        exact[np.isinf(np.take_along_axis(d, found, axis=1))] = np.inf
        order = np.argsort(exact, axis=1, kind="stable")
        near[at : at + step], far[at : at + step] = np.take_along_axis(found, order, axis=1), np.take_along_axis(exact, order, axis=1)
    return near, far


def _grown(core: np.ndarray, near: np.ndarray, far: np.ndarray, part: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray, np.ndarray]:
    """Boruvka's rounds as far as known neighbours decide: new edges, parts, and points whose neighbours must be found anew.

    All of a point's edges to unknown points weigh at least as much as its last
    known one, so a part's least known edge is its least one if no point
    without a known edge to another part has a smaller bound.
    """
    weight = np.maximum(np.maximum(far, core[:, None]), core[near])
    bound = np.maximum(far[:, -1], core)
    weight[weight > bound[:, None]] = np.inf
    part, edges = part.copy(), []
    n = len(core)
    while True:
        own = np.where(part[near] != part[:, None], weight, np.inf)
        at = own.argmin(axis=1)
        least = own[np.arange(n), at]
        blind = np.isinf(least)
        upper, lower = np.full(n, np.inf), np.full(n, np.inf)
        np.minimum.at(upper, part, least)
        np.minimum.at(lower, part[blind], bound[blind])
        sure = np.isfinite(upper) & (upper <= lower)
        if not sure.any():
            need = np.flatnonzero(blind & (bound < upper[part])) if len(np.unique(part)) > 1 else np.zeros(0, dtype=np.int64)
            return edges, part, need
        chosen = np.flatnonzero(sure[part] & (least == upper[part]))
        _, first = np.unique(part[chosen], return_index=True)
        chosen = chosen[first]
        root = np.arange(n)

        def find(x: int, root: np.ndarray = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        for i in chosen:
            j = int(near[i, at[i]])
            a, b = find(int(part[i])), find(int(part[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(i), j, float(least[i])))
        while (root[root] != root).any():
            root = root[root]
        part = root[part]


def _in_shares(vectors: DataFrame, kind: str, min_samples: int, min_cluster_size: int) -> DataFrame:
    """Density clusters of any number of points: neighbours in shares, the tree's edges from them, the hierarchy in one task."""
    numbers = vectors.select("id", "vector").orderBy("id").select(F.monotonically_increasing_id().alias("key"), "id", "vector")
    points = written(numbers, "points")
    k = max(NEAR, min_samples)

    def sorted_points(parts: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(list(parts)).sort_by("key")
        return table, _matrix(table["vector"], len(table))

    lists = "num bigint, core double, near array<bigint>, far array<double>"

    def rows_of(num: np.ndarray, core: np.ndarray, near: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(num) + 1, dtype=np.int32) * near.shape[1])
        return pa.RecordBatch.from_pydict(
            {"num": pa.array(num), "core": pa.array(core), "near": pa.ListArray.from_arrays(ends, pa.array(near.ravel())), "far": pa.ListArray.from_arrays(ends, pa.array(far.ravel()))}
        )

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sorted_points(parts)
        n = len(own)
        rows = np.arange(table["share"][0].as_py(), n, SHARES)
        near, far = _nearest(own, rows, min(k, n - 1), None, None)
        core = far[:, min(min_samples, n - 1) - 1] if min_samples > 0 else np.zeros(len(rows))
        yield rows_of(rows, np.ascontiguousarray(core), near, far)

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sorted_points(parts)
        n = len(own)
        core, part = table["core"].to_numpy(), table["part"].to_numpy()
        rows = np.flatnonzero(table["need"].to_numpy(zero_copy_only=False))[table["share"][0].as_py() :: SHARES]
        near, far = _nearest(own, rows, min(k, n - 1), core, part)
        yield rows_of(rows, core[rows], near, far)

    def grow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a point: its part and whether it is needed; and rows of edges (num, other, weight)."""
        table = pa.Table.from_batches(list(parts))
        known = table.take(np.lexsort((table["turn"].to_numpy(), table["num"].to_numpy())))
        num = known["num"].to_numpy()
        known = known.take(np.flatnonzero(np.append(np.diff(num) != 0, True)))  # the last turn counts
        n = len(known)
        core, part = known["core"].to_numpy(), known["part"].to_numpy()
        near, far = _matrix(known["near"], n).astype(np.int64), _matrix(known["far"], n)
        edges, part, need = _grown(core, near, far, part)
        needed = np.zeros(n, dtype=bool)
        needed[need] = True
        a, b, w = np.array(edges, dtype=float).reshape(-1, 3).T
        yield pa.RecordBatch.from_pydict(
            {
                "num": pa.array(np.concatenate([np.arange(n), a.astype(np.int64)])),
                "other": pa.array(np.concatenate([np.full(n, -1), b.astype(np.int64)])),
                "part": pa.array(np.concatenate([part, np.zeros(len(a), dtype=np.int64)])),
                "value": pa.array(np.concatenate([core, w])),
                "need": pa.array(np.concatenate([needed, np.zeros(len(a), dtype=bool)])),
            }
        )

    for f in (first, again, grow):
        f.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}

    def found(df: DataFrame, turn: int) -> DataFrame:
        return written(df.withColumn("turn", F.lit(turn)), "near")

    known = found(_to_all(points, SHARES).groupBy("share").applyInArrow(first, lists), 0)
    states: list[DataFrame] = []
    numbered = written(points.select("key").orderBy("key").coalesce(1).mapInPandas(_counted, "key bigint, num bigint"), "numbers")
    turn = 0
    while True:
        part: Column = F.col("num")
        rows = known
        if states:
            before = states[-1].filter("other < 0").select("num", F.col("part"))
            rows = known.join(before, "num")
            part = F.col("part")
        told = rows.select("turn", "num", part.alias("part"), "core", "near", "far")
        state = written(told.repartition(1).mapInArrow(grow, "num bigint, other bigint, part bigint, value double, need boolean"), "parts")
        states.append(state)
        if state.filter("need").isEmpty():
            break
        turn += 1
        now = state.filter("other < 0").select("num", "part", F.col("value").alias("core"), "need")
        dealt = points.select("key", "vector").join(numbered, "key").join(now, "num").select("key", "vector", "part", "core", "need")
        known = known.union(found(_to_all(dealt, SHARES).groupBy("share").applyInArrow(again, lists), turn))
    edges = states[0].filter("other >= 0")
    for s in states[1:]:
        edges = edges.union(s.filter("other >= 0"))

    def cluster(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(parts))
        n = int((own["other"] == -2).sum())
        tree = own[own["other"] >= 0].sort_values(["value", "num", "other"])
        label, probability, outlier = _of_tree(tree[["num", "other", "value"]].to_numpy(dtype=float), n, min_cluster_size)
        yield pd.DataFrame({"num": np.arange(n), "cluster_id": label, "probability": probability, "outlier_score": outlier})

    every = edges.select("num", "other", "value").union(numbered.select("num", F.lit(-2).cast("long"), F.lit(0.0)))
    labels = every.coalesce(1).mapInPandas(cluster, "num bigint, cluster_id bigint, probability double, outlier_score double")
    named = points.select("key", "id").join(numbered, "key").join(labels, "num")
    return named.select(F.col("id").cast(kind).alias("id"), "cluster_id", "probability", "outlier_score")


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, num: numbers from 0 in the order of the keys."""
    own = pd.concat(list(parts)).sort_values("key", ignore_index=True)
    yield pd.DataFrame({"key": own["key"], "num": np.arange(len(own))})


def density_clusters(points: np.ndarray, min_samples: int, min_cluster_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, probability, outlier score) by the stability of clusters as density falls."""
    n = len(points)
    label, probability, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    if n < 2:
        return label, probability, outlier
    core = np.empty(n)
    for i in range(n):
        far = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        core[i] = np.partition(far, min(min_samples, n - 1))[min(min_samples, n - 1)]
    return _of_tree(_spanning_tree(points, core), n, min_cluster_size)


def _of_tree(tree: np.ndarray, n: int, min_cluster_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, probability, outlier score) from a spanning tree by rising distance."""
    label, probability, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    # Single linkage: node n + i joins two nodes at a distance.
    parent = np.arange(2 * n - 1)
    child = np.zeros((n - 1, 2), dtype=int)
    size = np.ones(2 * n - 1, dtype=int)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for i, (a, b, _) in enumerate(tree):
        ra, rb = find(int(a)), find(int(b))
        child[i] = ra, rb
        parent[ra] = parent[rb] = n + i
        size[n + i] = size[ra] + size[rb]
    density = 1.0 / np.maximum(tree[:, 2], 1e-12)
    # Condense from the top: a split into two large parts makes two clusters.
    birth, children, fell, stable = {0: 0.0}, {0: []}, [], {0: 0.0}
    stack = [(2 * n - 2, 0)]
    last = 0
    while stack:
        node, cluster = stack.pop()
        if node < n:
            fell.append((node, cluster, np.inf if n == 1 else density[0]))
            continue
        level = density[node - n]
        left, right = child[node - n]
        large = [x for x in (left, right) if size[x] >= min_cluster_size]
        if len(large) == 2:
            for x in large:
                last += 1
                birth[last], children[last], stable[last] = level, [], 0.0
                children[cluster].append(last)
                stable[cluster] += (level - birth[cluster]) * size[x]
                stack.append((int(x), last))
        else:
            for x in (left, right):
                if x in large:
                    stack.append((int(x), cluster))
                else:
                    for leaf in _leaves(int(x), child, n):
                        fell.append((leaf, cluster, level))
                        stable[cluster] += level - birth[cluster]
    chosen: set[int] = set()
    value = dict(stable)
    for c in range(last, 0, -1):
        below = sum(value[x] for x in children[c])
        if children[c] and below > stable[c]:
            value[c] = below
        else:
            chosen.add(c)
    for c in sorted(chosen):
        todo = list(children[c])
        while todo:
            x = todo.pop()
            chosen.discard(x)
            todo += children[x]
    up = {x: c for c, xs in children.items() for x in xs}
    names = {c: i for i, c in enumerate(sorted(chosen))}
    peak: dict[int, float] = {}
    home = {}
    for leaf, cluster, level in fell:
        c = cluster
        while c not in chosen and c in up:
            c = up[c]
        home[leaf] = (c if c in chosen else None, level)
        if c in chosen:
            peak[c] = max(peak.get(c, 0.0), level)
    top = max((lv for _, lv in home.values()), default=0.0)
    for leaf, (c, level) in home.items():
        if c is not None:
            label[leaf] = names[c]
            probability[leaf] = min(1.0, level / peak[c]) if peak[c] else 0.0
            outlier[leaf] = 1.0 - probability[leaf]
        else:
            outlier[leaf] = 1.0 - (level / top if top else 0.0)
    return label, probability, outlier


def _leaves(node: int, child: np.ndarray, n: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x < n:
            out.append(x)
        else:
            todo += [int(child[x - n][0]), int(child[x - n][1])]
    return out
