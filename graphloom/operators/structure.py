"""Bridges and articulation points by joins alone.

A breadth-first tree is grown from the least node of each component.  With
preorder numbers and subtree sizes - found by doubling along a tour of the
tree - two tree arcs lie on a common cycle exactly if they are joined by the
rules of Tarjan and Vishkin, so the blocks of the graph are the components of a
graph over tree arcs.  No component is ever in one task; the trees take as many
rounds as they are deep, all else the logarithm of their size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.community import wcc
from graphloom.operators.projection import Projected, numbered, written


@dataclass(frozen=True)
class _Tree:
    """nodes: id, parent (null at a root), root, pre, size.  blocks: id of a tree
    arc's lower end, block.  pairs: src < dst."""

    nodes: DataFrame
    blocks: DataFrame
    pairs: DataFrame


def _tree(p: Projected) -> DataFrame:
    """id, parent (null at a root), root: breadth-first trees from the least node of each component."""
    arcs = written(p.both_ways().select("src", "dst"), "arcs")
    roots = wcc(p).filter("id = component_id").select("id", F.lit(None).cast("bigint").alias("parent"), F.col("id").alias("root"))
    front = written(roots, "front")
    levels = [front]
    while True:
        ahead = front.join(arcs, front.id == arcs.src).groupBy(F.col("dst").alias("id"), "root").agg(F.min("src").alias("parent"))
        # A neighbour of a level is in it, in the one before or in the next.
        known = reduce(DataFrame.union, levels[-2:]).select("id")
        front = written(ahead.join(known, "id", "left_anti").select("id", "parent", "root"), "front")
        if front.isEmpty():
            return written(reduce(DataFrame.union, levels), "tree")
        levels.append(front)


def _ranked(tree: DataFrame) -> DataFrame:
    """id, parent, root, pre, size: numbers in preorder from 0 in each tree, and sizes of subtrees.

    A tour goes down to a node and up from it again.  How many nodes it still
    goes down to is found by doubling, in rounds that grow as the logarithm of
    the tour's length, however deep the tree.
    """
    beside = Window.partitionBy("parent").orderBy("id")
    sibling = tree.filter("parent is not null").select("id", F.lead("id").over(beside).alias("sibling"))
    child = tree.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    node = tree.select("id", "parent").join(sibling, "id", "left").join(child, "id", "left")
    # (id, up) is a step of the tour; (next, then_up) the step after it.
    down = node.select("id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("next"), F.col("child").isNull().alias("then_up"), F.lit(1).cast("long").alias("left"))
    up = node.select("id", F.lit(True).alias("up"), F.coalesce("sibling", "parent").alias("next"), F.col("sibling").isNull().alias("then_up"), F.lit(0).cast("long").alias("left"))
    tour = written(down.union(up), "tour")
    while not tour.filter("next is not null").isEmpty():
        after = tour.select(F.col("id").alias("at"), F.col("up").alias("at_up"), F.col("next").alias("further"), F.col("then_up").alias("further_up"), F.col("left").alias("more"))
        doubled = tour.join(after, (F.col("next") == F.col("at")) & (F.col("then_up") == F.col("at_up")), "left")
        tour = written(
            doubled.select("id", "up", F.col("further").alias("next"), F.col("further_up").alias("then_up"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour"
        )
    both = tour.groupBy("id").agg(F.max(F.when(~F.col("up"), F.col("left"))).alias("down"), F.max(F.when(F.col("up"), F.col("left"))).alias("up"))
    own = tree.join(both, "id")
    total = own.filter("parent is null").select("root", F.col("down").alias("total"))
    return written(own.join(total, "root").select("id", "parent", "root", (F.col("total") - F.col("down")).alias("pre"), (F.col("down") - F.col("up")).alias("size")), "numbered")


def _spans(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """id, low, high: the least and greatest of a value pair over a node's subtree, which is a run of preorder numbers.

    Runs of 1, 2, 4, ... numbers are found by doubling; a subtree is two of them that may overlap.
    """
    k = F.floor(F.log2("size") + 1e-9).cast("int")
    asked = written(nodes.select("id", "root", "pre", k.alias("k"), "size"), "asked")
    most = asked.agg(F.max("k")).first()[0]
    runs = written(nodes.join(own, "id").select("root", "pre", "low", "high"), "runs")
    found = []
    for level in range((most or 0) + 1):
        wide = 1 << level
        here = asked.filter(F.col("k") == level).select("id", "root", "pre", (F.col("pre") + F.col("size") - wide).alias("last"))
        first = runs.select(F.col("root").alias("r1"), F.col("pre").alias("p1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
        second = runs.select(F.col("root").alias("r2"), F.col("pre").alias("p2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
        both = here.join(first, (F.col("root") == F.col("r1")) & (F.col("pre") == F.col("p1"))).join(second, (F.col("root") == F.col("r2")) & (F.col("last") == F.col("p2")))
        found.append(both.select("id", F.least("l1", "l2").alias("low"), F.greatest("h1", "h2").alias("high")))
        if level < (most or 0):
            after = runs.select(F.col("root").alias("r"), (F.col("pre") - wide).alias("q"), F.col("low").alias("l"), F.col("high").alias("h"))
            runs = written(
                runs.join(after, (F.col("root") == F.col("r")) & (F.col("pre") == F.col("q"))).select("root", "pre", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")), "runs"
            )
    return written(reduce(DataFrame.union, found), "spans")


def _numbered(p: Projected) -> _Tree:
    nodes = _ranked(_tree(p))
    pairs = written(p.pairs().select("src", "dst"), "pairs")
    return _Tree(nodes, _blocks(nodes, pairs), pairs)


def _blocks(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    n = nodes.select("id", "parent", "pre", "size")
    ends = pairs.join(n.toDF("src", "ps", "pre_s", "size_s"), "src").join(n.toDF("dst", "pd", "pre_d", "size_d"), "dst")
    extra = written(ends.filter("not (ps <=> dst or pd <=> src)"), "extra")
    # Least and greatest number that a node's extra edges reach, then of its subtree.
    reach = extra.select(F.col("src").alias("id"), F.col("pre_d").alias("far")).union(extra.select("dst", "pre_s"))
    own = nodes.join(reach.groupBy("id").agg(F.min("far").alias("a"), F.max("far").alias("b")), "id", "left").select(
        "id", F.least("pre", F.coalesce("a", "pre")).alias("low"), F.greatest("pre", F.coalesce("b", "pre")).alias("high")
    )
    span = _spans(nodes, own)
    # Ends of an extra edge in different branches.
    apart = extra.filter("not (pre_d >= pre_s and pre_d < pre_s + size_s) and not (pre_s >= pre_d and pre_s < pre_d + size_d)").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    # A tree arc and the one above it, if something below leaves the upper end's subtree.
    child = nodes.select("id", "parent").join(span, "id")
    above = nodes.filter("parent is not null").select(F.col("id").alias("up"), F.col("pre").alias("pre_u"), F.col("size").alias("size_u"))
    joined = child.join(above, F.col("parent") == F.col("up")).filter("low < pre_u or high >= pre_u + size_u").select(F.col("id").alias("a"), F.col("up").alias("b"))
    found = connected_components(apart.union(joined), "a", "b")
    lower = nodes.filter("parent is not null").select("id")
    return written(lower.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("block")), "blocks")


def bridges(p: Projected) -> DataFrame:
    """from, to, remaining_sizes: edges without which a component falls apart, and the sizes
    of what is left at ``from`` and at ``to``; from < to.  Parallel edges count as one."""
    p, names = numbered(p)
    t = _numbered(p)
    alone = t.blocks.groupBy("block").agg(F.count("*").alias("n"), F.max("id").alias("id")).filter("n = 1")
    # A block of one tree arc; a cycle has two tree arcs at least.
    low = t.nodes.select("id", "parent", "pre", "size", "root").join(alone.select("id"), "id")
    whole = t.nodes.filter("parent is null").select("root", F.col("size").alias("total"))
    own = low.join(whole, "root").filter("parent is not null")
    first = F.col("id") < F.col("parent")
    below, above = F.col("size"), F.col("total") - F.col("size")
    out = own.select(
        F.least("id", "parent").alias("from"),
        F.greatest("id", "parent").alias("to"),
        F.when(first, F.array(below, above)).otherwise(F.array(above, below)).alias("remaining_sizes"),
    )
    return out if names is None else names.of(names.of(out, "from"), "to")


def articulation_points(p: Projected) -> DataFrame:
    """id, resulting_components: nodes without which their component falls into so many parts (2 or more)."""
    p, names = numbered(p)
    t = _numbered(p)
    arcs = t.nodes.select("id", "parent").join(t.blocks, "id")
    touching = arcs.select("id", "block").union(arcs.select(F.col("parent").alias("id"), "block")).filter("id is not null").distinct()
    out = touching.groupBy("id").agg(F.count("*").alias("resulting_components")).filter("resulting_components >= 2")
    return out if names is None else names.of(out, "id")
