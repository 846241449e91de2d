"""What graph algorithms run on: ids and weighted arcs.

Parallel edges are one arc with the sum of their weights; an undirected
relation gives arcs both ways.  Self-loops are kept apart by a flag of the
caller, since most algorithms ignore them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.lineage import drop_written, written

#: Rounds of a loop after which its state is written and read back.
ROUNDS_PER_CUT = 5


@dataclass(frozen=True)
class Projected:
    """nodes(id), arcs(src, dst, w).  ``directed`` says what the relation is."""

    spark: SparkSession
    nodes: DataFrame
    arcs: DataFrame
    directed: bool

    def both_ways(self) -> DataFrame:
        """src, dst, w as an undirected graph without self-loops."""
        own = self.arcs.filter("src <> dst")
        if not self.directed:
            return own
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return own.union(back).groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def pairs(self) -> DataFrame:
        """Each undirected pair once, src < dst."""
        return self.both_ways().filter("src < dst")


def project(nodes: DataFrame, edges: DataFrame, directed: bool, weight: str | None = None) -> Projected:
    """``nodes`` has an ``id``; ``edges`` has src, dst and perhaps the weight.

    Edges with a null end or with an end that is no node are left out; a null
    weight counts as 0.
    """
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    own = edges.select("src", "dst", w.alias("w")).filter("src is not null and dst is not null")
    if not directed:
        own = own.union(own.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    ids = nodes.select("id").filter("id is not null").distinct()
    arcs = own.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    arcs = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    spark = nodes.sparkSession
    return Projected(spark, written(ids, "nodes"), written(arcs.select("src", "dst", "w"), "arcs"), directed)


def loop(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, name: str = "state") -> DataFrame:
    """``rounds`` applications of a step that uses its argument once, cut every few rounds."""
    for i in range(1, rounds + 1):
        state = step(state)
        if i % ROUNDS_PER_CUT == 0 and i < rounds:
            state = written(state, name)
    return state


class Unsettled(RuntimeError):
    """A loop met its bound before its state was settled."""


def until_settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], object], most: int, name: str = "state") -> DataFrame:
    """Apply a step, written each time, until ``mark`` of the state doesn't change; after ``most`` rounds it fails."""
    now = written(state, name)
    seen = mark(now)
    for _ in range(most):
        after = written(step(now), name)
        drop_written(now)
        now = after
        if (was := seen) == (seen := mark(now)):
            return now
    raise Unsettled(f"{name} didn't settle in {most} rounds")


def checksum(*columns: str) -> Callable[[DataFrame], object]:
    """A mark that tells states apart by their rows, in any order: exact sums of two hashes."""

    def mark(df: DataFrame) -> object:
        hashes = [F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(20,0)")) for k in (0, 1)]
        return tuple(df.agg(F.count("*"), *hashes).first())

    return mark


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Numbering:
    """(num, key): whole numbers for keys of another type, in the order of the keys."""

    names: DataFrame

    def of(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the keys in a column instead of numbers; null stays null."""
        own = self.names.select(F.col("num").alias("__num"), F.col("key").alias("__key"))
        columns = [F.col("__key").alias(c) if c == column else F.col(c) for c in df.columns]
        return df.join(own, F.col(column) == F.col("__num"), "left").select(*columns)

    def of_arrays(self, df: DataFrame, column: str, by: str = "id") -> DataFrame:
        """The same for an array column of rows that ``by`` tells apart; places are kept."""
        each = self.of(df.select(by, F.posexplode(column).alias("__at", "__n")), "__n")
        own = each.groupBy(F.col(by).alias("__by")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__n"))), lambda x: x["__n"]).alias("__own"))
        kind = df.sparkSession.createDataFrame([], self.names.schema).schema["key"].dataType
        columns = [F.coalesce("__own", F.array().cast(T.ArrayType(kind))).alias(c) if c == column else F.col(c) for c in df.columns]
        return df.join(own, F.col(by) == F.col("__by"), "left").select(*columns)


def numbered(p: Projected) -> tuple[Projected, Numbering | None]:
    """The graph over whole numbers, and what gives keys back; None where keys are whole numbers already.

    Numbers follow a sort of the keys, so the least number is the least key,
    and every key has its own.
    """
    if isinstance(p.nodes.schema["id"].dataType, INTEGRAL):
        return p, None
    names = written(p.nodes.select(F.col("id").alias("key")).orderBy("key").select(F.monotonically_increasing_id().alias("num"), "key"), "numbers")
    a, b = names.toDF("a", "src"), names.toDF("b", "dst")
    arcs = p.arcs.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return Projected(p.spark, names.select(F.col("num").alias("id")), written(arcs, "arcs"), p.directed), Numbering(names)
