"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.lineage import drop_written, written

MAX_ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; partial sums before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("u", "m").alias("m")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), F.col("u") == F.col("c"))
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("c")).filter("v <> m")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: exact sums of two hashes."""
    return tuple(edges.agg(F.count("*"), *(F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(20,0)")) for k in (0, 1))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): for each end of an edge that is not alone, the least id it reaches.

    ``edges`` holds undirected pairs of whole numbers (other keys fail; number
    them first); nulls, self-loops and repeated pairs are ignored.  Ids that occur only in self-loops are not
    returned, so callers left-join and take the id itself.  Each round is two
    aggregations with map-side partial minima and two equi-joins that adaptive
    execution may split; the rounds grow as the logarithm of the longest
    chain.  An empty input gives an empty result.
    """
    for end in (src, dst):
        if not isinstance(edges.schema[end].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise TypeError(f"{end} holds no whole numbers")
    now = written(
        edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(MAX_ROUNDS if mark[0] else 0):
        after = written(_small_star(_large_star(now)), "stars")
        now, old = after, now
        drop_written(old)
        if (was := mark) == (mark := _mark(now)):
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
