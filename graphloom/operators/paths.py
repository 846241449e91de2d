"""Distances and routes."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import kernels
from graphloom.operators.projection import Projected, Unsettled, written

#: Rounds after which a distance computation fails.
MOST_ROUNDS = 10_000
#: Targets that are broadcast to pair them with sources; more meet in buckets.
MOST_BROADCAST = 100_000


class NegativeWeight(ValueError):
    """Shortest paths need weights that aren't negative."""


def _check_weights(p: Projected) -> None:
    low = p.arcs.agg(F.min("w")).first()[0]
    if low is not None and low < 0:
        raise NegativeWeight("a weight is negative")


def all_distances(p: Projected, weighted: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """source, id, dist: from each source to every node it reaches, itself included.

    Unweighted it goes by levels: a round joins only the newest nodes.
    Weighted it relaxes what improved in the round before.
    """
    start = (p.nodes if sources is None else sources).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))
    arcs = p.arcs.filter("src <> dst")
    if weighted:
        _check_weights(p)
        return _relaxed(start, arcs)
    front = written(start, "dist")
    levels = [front]
    while True:
        ahead = front.join(arcs, front.id == arcs.src).select("source", F.col("dst").alias("id")).distinct()
        known = reduce(DataFrame.union, levels).select("source", "id")
        front = written(ahead.join(known, ["source", "id"], "left_anti").withColumn("dist", F.lit(float(len(levels)))), "front")
        if front.isEmpty():
            return reduce(DataFrame.union, levels)
        levels.append(front)


def _relaxed(start: DataFrame, arcs: DataFrame) -> DataFrame:
    best = front = written(start, "dist")
    for _ in range(MOST_ROUNDS):
        offers = front.join(arcs, front.id == arcs.src).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        front = written(
            offers.join(best, ["source", "id"], "left").filter("dist is null or offer < dist").select("source", "id", F.col("offer").alias("dist")), "front"
        )
        if front.isEmpty():
            return best
        best = written(best.union(front).groupBy("source", "id").agg(F.min("dist").alias("dist")), "dist")
    raise Unsettled(f"distances didn't settle in {MOST_ROUNDS} rounds")


def _pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of ends, one for each route asked for; a source is no route to itself.

    Both are selections that the caller states.  Up to ``MOST_BROADCAST``
    targets are broadcast; more are dealt into buckets that every source goes to.
    """
    a = sources.select(F.col("id").alias("source")).filter("source is not null").distinct()
    b = written(targets.select(F.col("id").alias("target")).filter("target is not null").distinct(), "targets")
    n = b.count()
    if n <= MOST_BROADCAST:
        return a.join(F.broadcast(b), F.col("source") != F.col("target"))
    buckets = -(-n // MOST_BROADCAST)
    sent = a.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dealt = b.withColumn("bucket", F.pmod(F.xxhash64("target"), F.lit(buckets)).cast("int"))
    return sent.join(dealt, "bucket").filter("source <> target").select("source", "target")


def shortest_routes(p: Projected, sources: DataFrame, targets: DataFrame, max_depth: int | None = None, every: bool = False) -> DataFrame:
    """source, target, nodes, hop_count, total_cost: a path with fewest hops for each pair, or all of them.

    Of equally short paths the one whose nodes come first in order is taken.
    Pairs without a path within ``max_depth`` hops are absent.  Levels are
    found first, by node; only arcs between neighbouring levels on the way to a
    target are then put together to paths.  Where one path is asked for, it is
    found with the levels, in tasks that share the sources.
    """
    if not every and kernels.routable(p):
        return kernels.shortest_from(p, sources, targets, max_depth)
    arcs = p.arcs.filter("src <> dst").select("src", "dst")
    begin = sources.filter("id is not null").select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")).distinct()
    front = written(begin.join(p.nodes, "id", "left_semi").select("source", "id", "hops"), "levels")
    levels = [front]
    while max_depth is None or len(levels) <= max_depth:
        ahead = front.join(arcs, front.id == arcs.src).select("source", F.col("dst").alias("id")).distinct()
        known = reduce(DataFrame.union, levels).select("source", "id")
        front = written(ahead.join(known, ["source", "id"], "left_anti").withColumn("hops", F.lit(len(levels))), "front")
        if front.isEmpty():
            break
        levels.append(front)
    done = reduce(DataFrame.union, levels)
    # What is reached and asked for: pairs are made of reached nodes only.
    ends = done.filter("id <> source").join(targets.select("id").distinct(), "id", "left_semi").select("source", F.col("id").alias("target"), "hops")
    # Back from the targets, one level at a time; ``nodes`` is the path from here on.
    level = written(ends.select("source", "target", "hops", F.col("target").alias("at"), F.array("target").alias("nodes")), "tails")
    out = []
    while True:
        out.append(level.filter("at = source"))
        rest = level.filter("at <> source")
        before = done.select(F.col("source").alias("s2"), F.col("id").alias("u"), F.col("hops").alias("hu"))
        stepped = (
            rest.join(arcs, rest["at"] == arcs.dst)
            .join(before, (F.col("source") == F.col("s2")) & (F.col("src") == F.col("u")) & (F.col("hu") == F.col("hops") - F.size("nodes")))
            .select("source", "target", "hops", F.col("src").alias("at"), F.concat(F.array("src"), F.col("nodes")).alias("nodes"))
        )
        if not every:
            # From each node, the first path in order is enough.
            stepped = stepped.groupBy("source", "target", "hops", "at").agg(F.min("nodes").alias("nodes"))
        level = written(stepped, "tails")
        if level.isEmpty():
            break
    found = reduce(DataFrame.union, out)
    if not every:
        found = found.groupBy("source", "target", "hops").agg(F.min("nodes").alias("nodes"))
    return found.select("source", "target", "nodes", F.col("hops").alias("hop_count"), F.col("hops").cast("double").alias("total_cost"))


def dijkstra(p: Projected, sources: DataFrame, targets: DataFrame, nodes: bool = True) -> DataFrame:
    """source, target, nodes, hop_count, total_cost: a path of least weight for each pair that has one.

    Ties go to fewer hops, then to the path whose nodes come first in order.
    Without ``nodes`` paths aren't put together.  Sources are shared among tasks.
    """
    _check_weights(p)
    if kernels.routable(p):
        return kernels.least_from(p, sources, targets, nodes, MOST_ROUNDS)
    found = _from_sources(p, sources, targets)
    return found if nodes else found.drop("nodes")


def _from_sources(p: Projected, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Least (cost, hops, nodes) from each source to every node, then those asked for.

    A round extends only what improved; a node's entry holds its cost, its hops
    and its path, of which the least in order wins.  A path of so many hops
    needs so many rounds; ``MOST_ROUNDS`` without an end fail.
    """
    arcs = p.arcs.filter("src <> dst").select("src", "dst", "w")
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("id").alias("nodes")).alias("path")
    best = front = written(sources.select("id").filter("id is not null").distinct().join(p.nodes, "id", "left_semi").select(F.col("id").alias("source"), F.col("id").alias("at"), start), "paths")
    for _ in range(MOST_ROUNDS):
        further = F.struct((F.col("path.cost") + F.col("w")).alias("cost"), (F.col("path.hops") + 1).alias("hops"), F.concat("path.nodes", F.array("dst")).alias("nodes"))
        ahead = front.join(arcs, front["at"] == arcs.src).select("source", F.col("dst").alias("at"), further.alias("path")).groupBy("source", "at").agg(F.min("path").alias("offer"))
        better = ahead.join(best, ["source", "at"], "left").filter("path is null or offer < path")
        front = written(better.select("source", "at", F.col("offer").alias("path")), "front")
        if front.isEmpty():
            found = best.filter("source <> at").join(targets.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
            return found.select("source", F.col("at").alias("target"), "path.nodes", F.col("path.hops").alias("hop_count"), F.col("path.cost").alias("total_cost"))
        best = written(best.union(front).groupBy("source", "at").agg(F.min("path").alias("path")), "paths")
    raise Unsettled(f"routes didn't settle in {MOST_ROUNDS} rounds")


def _weighted(p: Projected, wanted: DataFrame, bound: Column, coordinates: DataFrame) -> DataFrame:
    """Relax (cost, hops, nodes) for each pair until nothing improves.

    A partial path whose cost and remaining bound together exceed what a path
    to the pair's target costs already is dropped.
    """
    arcs = p.arcs.filter("src <> dst").select("src", "dst", "w")
    best = front = written(wanted.select("source", "target", F.col("source").alias("at"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("source").alias("nodes")).alias("path")), "paths")
    for _ in range(MOST_ROUNDS):
        ahead = (
            front.join(arcs, front["at"] == arcs.src)
            .filter(~F.array_contains("path.nodes", F.col("dst")))
            .select(
                "source",
                "target",
                F.col("dst").alias("at"),
                F.struct((F.col("path.cost") + F.col("w")).alias("cost"), (F.col("path.hops") + 1).alias("hops"), F.concat("path.nodes", F.array("dst")).alias("nodes")).alias("path"),
            )
            .groupBy("source", "target", "at")
            .agg(F.min("path").alias("offer"))
        )
        reached = best.filter("at = target").select(F.col("source").alias("s2"), F.col("target").alias("t2"), F.col("path.cost").alias("limit"))
        better = ahead.join(best, ["source", "target", "at"], "left").filter("path is null or offer < path").drop("path")
        better = better.join(reached, (F.col("source") == F.col("s2")) & (F.col("target") == F.col("t2")), "left")
        here = coordinates.select(F.col("id").alias("c1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
        there = coordinates.select(F.col("id").alias("c2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        better = better.join(here, F.col("at") == F.col("c1"), "left").join(there, F.col("target") == F.col("c2"), "left")
        kept = better.filter(F.col("limit").isNull() | (F.col("offer.cost") + F.coalesce(bound, F.lit(0.0)) <= F.col("limit") + 1e-9))
        front = written(kept.select("source", "target", "at", F.col("offer").alias("path")), "front")
        if front.isEmpty():
            return best.filter("at = target").select("source", "target", "path.nodes", F.col("path.hops").alias("hop_count"), F.col("path.cost").alias("total_cost"))
        best = written(best.union(front).groupBy("source", "target", "at").agg(F.min("path").alias("path")), "paths")
    raise Unsettled(f"routes didn't settle in {MOST_ROUNDS} rounds")


EARTH_RADIUS = kernels.EARTH_RADIUS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def a_star(p: Projected, sources: DataFrame, targets: DataFrame, coordinates: DataFrame, scale: float = 1.0, nodes: bool = True) -> DataFrame:
    """As :func:`dijkstra`, with partial paths pruned by the distance over ground.

    ``coordinates`` has id, lat, lon in degrees.  ``scale`` turns kilometres
    into weight; it must not make the bound exceed the true cost.  The targets
    of a source share one search: a partial path goes on while any of them may
    still gain by it.
    """
    _check_weights(p)
    if kernels.routable(p):
        return kernels.least_from(p, sources, targets, nodes, MOST_ROUNDS, coordinates, scale)
    wanted = written(_pairs(sources, targets), "ends")
    bound = scale * haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    found = _weighted(p, wanted, bound, coordinates)
    return found if nodes else found.drop("nodes")


def yen(p: Projected, sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """source, target, rank, nodes, hop_count, total_cost: the k least paths without a repeated node, of any number of hops.

    Ties go to fewer hops, then to order.  In tasks that share the sources, the
    first walks to all nodes are found at once; see :mod:`kernels`.  By joins,
    distances to each target bound what a partial path can still cost; it is
    dropped when k whole paths cost less than that.
    """
    if k <= 0:
        raise ValueError("k is positive")
    _check_weights(p)
    if kernels.routable(p):
        return kernels.first_from(p, sources, targets, k)
    arcs = p.arcs.filter("src <> dst").select("src", "dst", "w")
    wanted = written(_pairs(sources, targets), "ends")
    back = Projected(p.spark, p.nodes, p.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), p.directed)
    rest = all_distances(back, weighted=True, sources=targets.select("id")).select(F.col("source").alias("t2"), F.col("id").alias("n2"), F.col("dist").alias("rest"))
    order = Window.partitionBy("source", "target").orderBy("cost", "hops", "nodes")
    whole = None
    front = written(wanted.select("source", "target", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("source").alias("nodes")), "front")
    for _ in count():
        at = F.element_at("nodes", -1)
        ahead = (
            front.withColumn("at", at)
            .join(arcs, F.col("at") == arcs.src)
            .filter(~F.array_contains("nodes", F.col("dst")))
            .select("source", "target", (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("nodes", F.array("dst")).alias("nodes"))
        )
        ahead = written(ahead, "ahead")
        done = ahead.filter(F.element_at("nodes", -1) == F.col("target"))
        whole = done if whole is None else whole.union(done)
        whole = written(whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "whole")
        limit = whole.groupBy("source", "target").agg(F.count("*").alias("n"), F.max("cost").alias("worst")).filter(F.col("n") >= k).select(F.col("source").alias("s3"), F.col("target").alias("t3"), "worst")
        open_ = ahead.filter(F.element_at("nodes", -1) != F.col("target")).withColumn("at", F.element_at("nodes", -1))
        open_ = open_.join(rest, (F.col("target") == F.col("t2")) & (F.col("at") == F.col("n2"))).join(limit, (F.col("source") == F.col("s3")) & (F.col("target") == F.col("t3")), "left")
        front = written(open_.filter(F.col("worst").isNull() | (F.col("cost") + F.col("rest") <= F.col("worst") + 1e-9)).select("source", "target", "cost", "hops", "nodes"), "front")
        if front.isEmpty():
            break
    ranked = whole.withColumn("rank", F.row_number().over(order)) if whole is not None else front.withColumn("rank", F.lit(1))
    return ranked.select("source", "target", F.col("rank").cast("int").alias("rank"), "nodes", F.col("hops").alias("hop_count"), F.col("cost").alias("total_cost"))
