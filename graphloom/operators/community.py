"""Communities, components and local density."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.projection import Projected, Unsettled, checksum, numbered, until_settled, written

MOST_ROUNDS = 1000


# --- components -------------------------------------------------------------------


def wcc(p: Projected) -> DataFrame:
    """id, component_id: the least id that a node reaches when directions don't matter."""
    p, names = numbered(p)
    kind = p.nodes.schema["id"].dataType
    found = connected_components(p.arcs, "src", "dst")
    out = p.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").cast(kind).alias("component_id"))
    return out if names is None else names.of(names.of(out, "component_id"), "id")


def scc(p: Projected) -> DataFrame:
    """id, component_id: nodes that reach each other, named by the least of them.

    The least id that reaches a node spreads forward; a node that kept its own
    id is a root, and what reaches a root among the nodes it coloured is its
    component.  Found components leave, and the rest goes on.  Before that,
    nodes that no cycle can hold leave: whole chains at once.  It fails rather
    than return a part after ``MOST_ROUNDS`` rounds.
    """
    found = []
    left = written(p.nodes, "left")
    arcs = written(p.arcs.filter("src <> dst").select("src", "dst"), "open")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        alone = _acyclic(left, arcs)
        if not alone.isEmpty():
            found.append(alone.select("id", F.col("id").alias("component_id")))
            left, arcs = _without(left, arcs, alone)
            continue
        open_arcs = arcs

        def forward(state: DataFrame, open_arcs: DataFrame = open_arcs) -> DataFrame:
            sent = open_arcs.join(state, open_arcs.src == state.id).select(F.col("dst").alias("id"), "color")
            return state.union(sent).groupBy("id").agg(F.min("color").alias("color"))

        colored = until_settled(left.select("id", F.col("id").alias("color")), forward, checksum("id", "color"), MOST_ROUNDS, "colors")
        a, b = colored.toDF("src", "cs"), colored.toDF("dst", "cd")
        same = written(arcs.join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst"), "same")
        done = front = written(colored.filter("id = color"), "back")
        while True:
            ahead = same.join(front, same.dst == front.id).select(F.col("src").alias("id"), "color").distinct()
            front = written(ahead.join(done, "id", "left_anti"), "front")
            if front.isEmpty():
                break
            done = written(done.union(front), "back")
        found.append(done.select("id", F.col("color").alias("component_id")))
        left, arcs = _without(left, same, done)
    else:
        if not left.isEmpty():
            raise Unsettled(f"nodes are left after {MOST_ROUNDS} rounds")
    if not found:
        return p.nodes.select("id", F.col("id").alias("component_id"))
    return reduce(DataFrame.union, found)


def _without(nodes: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = gone.select("id")
    kept = arcs.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return written(nodes.join(out, "id", "left_anti").select("id"), "left"), written(kept.select("src", "dst"), "open")


def _acyclic(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id: nodes without a way in, and those whose only way in comes from such a node, at any
    distance; and the same for ways out.  Found by doubling, in rounds that grow as the logarithm of a chain."""
    most = nodes.count()
    out = None
    for here, there in (("dst", "src"), ("src", "dst")):
        ways = arcs.groupBy(F.col(here).alias("id")).agg(F.count("*").alias("n"), F.min(there).alias("up"))
        state = nodes.join(ways, "id", "left").select("id", F.col("n").isNull().alias("ends"), F.when(F.col("n") == 1, F.col("up")).alias("up"))
        state = written(state, "chains")
        for _ in range(most.bit_length() + 1):
            above = state.select(F.col("id").alias("at"), F.col("ends").alias("done"), F.col("up").alias("next"))
            after = state.join(above, F.col("up") == F.col("at"), "left").select(
                "id", (F.col("ends") | F.coalesce("done", F.lit(False))).alias("ends"), F.when(~F.col("ends") & ~F.coalesce("done", F.lit(False)), F.col("next")).alias("up")
            )
            state = written(after, "chains")
            if state.filter("up is not null and not ends").isEmpty():
                break
        own = state.filter("ends").select("id")
        out = own if out is None else out.union(own)
    return written(out.distinct(), "found")


# --- density ----------------------------------------------------------------------


def _oriented(p: Projected) -> DataFrame:
    """Each undirected pair once, from the end with fewer neighbours: a hub has few arcs out."""
    both = p.both_ways().select("src", "dst")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    ends = both.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    return written(ends.filter("ds < dd or (ds = dd and src < dst)").select("src", "dst"), "oriented")


def _triangles(p: Projected) -> DataFrame:
    arcs = _oriented(p)
    wedges = arcs.toDF("a", "b").join(arcs.toDF("a", "c"), "a").filter("b <> c")
    return wedges.join(arcs.toDF("b", "c"), ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_count(p: Projected) -> DataFrame:
    """id, triangle_count: triangles through a node, directions and parallels aside."""
    corners = _triangles(p).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return p.nodes.join(corners, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangle_count"))


def local_clustering(p: Projected) -> DataFrame:
    """id, local_clustering_coefficient: 2 t / (d (d - 1)); 0 below two neighbours."""
    degree = p.both_ways().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    own = triangle_count(p).join(degree, "id", "left")
    value = F.when(F.col("d") >= 2, 2.0 * F.col("triangle_count") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return own.select("id", value.alias("local_clustering_coefficient"))


def clique_counting(p: Projected, max_k: int = 4) -> DataFrame:
    """id, clique_count, max_clique_size: cliques of 3 to ``max_k`` nodes through a node.

    Cliques grow by one node in a join, always along the orientation from
    fewer to more neighbours, so each is met once.
    """
    if max_k < 3:
        raise ValueError("cliques have 3 nodes at least")
    arcs = _oriented(p)
    now = arcs.select(F.array("src", "dst").alias("members"))
    found = []
    for k in range(3, max_k + 1):
        ahead = now.withColumn("a", F.element_at("members", 1)).join(arcs.toDF("a", "n"), "a")
        for i in range(2, k):
            ahead = ahead.withColumn("m", F.element_at("members", i)).join(arcs.toDF("m", "n"), ["m", "n"], "left_semi").drop("m")
        now = written(ahead.select(F.concat("members", F.array("n")).alias("members")), "cliques")
        found.append(now.select(F.explode("members").alias("id"), F.lit(k).alias("k")))
    own = reduce(DataFrame.union, found).groupBy("id").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    linked = p.both_ways().select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(2))
    return p.nodes.join(own, "id", "left").join(linked, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("clique_count"), F.coalesce("k", "linked", F.lit(1)).alias("max_clique_size")
    )


def kcore(p: Projected) -> DataFrame:
    """id, core_value: the largest k of a subgraph in which all have k neighbours.

    Each node's estimate becomes the h-index of its neighbours' until nothing
    changes; it starts at the degree and falls to the core value.
    """
    arcs = written(p.both_ways().select("src", "dst"), "arcs")
    start = p.nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"))
    down = Window.partitionBy("id").orderBy(F.desc("v"))

    def step(state: DataFrame) -> DataFrame:
        heard = arcs.join(state.toDF("dst", "v"), "dst").groupBy(F.col("src").alias("id"), "v").agg(F.count("*").alias("n"))
        summed = heard.withColumn("above", F.sum("n").over(down))
        index = summed.groupBy("id").agg(F.max(F.least("v", "above")).alias("h"))
        return state.join(index, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"))

    return until_settled(start, step, checksum("id", "core"), MOST_ROUNDS, "cores").select("id", F.col("core").alias("core_value"))


# --- labels -----------------------------------------------------------------------


def label_propagation(p: Projected, iterations: int = 10) -> DataFrame:
    """id, community_id: in each round all nodes at once take the label with most weight
    among the nodes they point to; ties go to the least label."""
    arcs = p.arcs.filter("src <> dst")
    now = written(p.nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(iterations):
        votes = arcs.join(now.toDF("dst", "vote"), "dst").groupBy(F.col("src").alias("id"), "vote").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "vote")).alias("best"))
        now = written(now.join(best, "id", "left").select("id", F.coalesce("best.vote", "label").alias("label")), "labels")
    return now.select("id", F.col("label").alias("community_id"))


def sllpa(p: Projected, iterations: int = 10, threshold: float = 0.1, seed: int = 42) -> DataFrame:
    """id, values: the communities a node heard often enough, in order.

    A node remembers one label for each round.  Every neighbour speaks one of
    its own, picked by a hash of the arc and the round; the listener keeps the
    most frequent, the least among equals.
    """
    arcs = p.both_ways().select("src", "dst")
    now = written(p.nodes.select("id", F.array("id").alias("memory")), "memory")
    for i in range(iterations):
        spoken = arcs.join(now.toDF("src", "memory"), "src").select(
            "dst", F.element_at("memory", (F.pmod(F.xxhash64("src", "dst", F.lit(i), F.lit(seed)), F.size("memory")) + 1).cast("int")).alias("word")
        )
        heard = spoken.groupBy(F.col("dst").alias("id"), "word").agg(F.count("*").alias("n"))
        best = heard.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("best"))
        now = written(now.join(best, "id", "left").select("id", F.when(F.col("best").isNull(), F.col("memory")).otherwise(F.concat("memory", F.array("best.word"))).alias("memory")), "memory")
    counted = now.select("id", F.size("memory").alias("size"), F.explode("memory").alias("word")).groupBy("id", "size", "word").agg(F.count("*").alias("n"))
    often = counted.filter(F.col("n") >= threshold * F.col("size")).groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("values"))
    return p.nodes.join(often, "id", "left").select("id", F.coalesce("values", F.array("id")).alias("values"))


def k1_coloring(p: Projected) -> DataFrame:
    """id, color: neighbours differ.

    In each round the nodes that come before all their uncoloured neighbours
    in the order of a hash take the least colour that no neighbour has.
    """
    arcs = p.both_ways().select("src", "dst")
    rank = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("i"))
    done = None
    left = written(p.nodes.select("id", rank.alias("rank")), "left")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        near = arcs.join(left.toDF("dst", "r"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("first"))
        turn = left.join(near, "id", "left").filter("first is null or rank < first").select("id")
        if done is None:
            colored = turn.withColumn("color", F.lit(0))
        else:
            taken = arcs.join(done.toDF("dst", "color"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("taken"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
            colored = turn.join(taken, "id", "left").select("id", F.when(F.col("taken").isNull(), 0).otherwise(free).alias("color"))
        new = written(colored, "colored")
        done = new if done is None else written(done.union(new), "colored")
        left = written(left.join(new, "id", "left_anti"), "left")
    else:
        if not left.isEmpty():
            raise Unsettled(f"nodes have no colour after {MOST_ROUNDS} rounds")
    return done if done is not None else p.nodes.withColumn("color", F.lit(0))


# --- modularity -------------------------------------------------------------------


def _with_communities(p: Projected, communities: DataFrame) -> DataFrame:
    """src, dst, w, cs, cd; ``communities`` has id and community."""
    c = communities.select("id", "community")
    return p.arcs.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst")


def modularity(p: Projected, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """community_id, modularity: share of arc weight inside, less what chance gives.

    Undirected arcs are counted from both ends, so a community's volume is in
    edge ends; for a directed relation the arcs count as undirected edges.
    """
    arcs = _with_communities(p, communities)
    if p.directed:
        arcs = arcs.union(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", F.col("cd").alias("x"), F.col("cs").alias("y")))
    total = arcs.agg(F.sum("w").alias("m2"))
    own = arcs.groupBy(F.col("cs").alias("community_id")).agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("volume"))
    value = F.col("inside") / F.col("m2") - resolution * F.pow(F.col("volume") / F.col("m2"), 2)
    return own.crossJoin(F.broadcast(total)).select("community_id", value.alias("modularity"))  # one row


def conductance(p: Projected, communities: DataFrame) -> DataFrame:
    """community_id, conductance: weight that leaves a community over its volume in edge ends."""
    arcs = _with_communities(p, communities)
    own = arcs.groupBy(F.col("cs").alias("community_id")).agg(F.sum(F.when(F.col("cs") != F.col("cd"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("volume"))
    return own.filter("volume > 0").select("community_id", (F.col("cut") / F.col("volume")).alias("conductance"))


def _quality(arcs: DataFrame, labels: DataFrame, resolution: float) -> float:
    """Modularity of labels(id, c) over symmetric arcs with loops."""
    c = labels.select("id", "c")
    both = arcs.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst")
    per = both.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("v"))
    row = per.agg(F.sum("i").alias("i"), F.sum(F.col("v") * F.col("v")).alias("s"), F.sum("v").alias("m")).first()
    return (row.i / row.m - resolution * row.s / row.m**2) if row.m else 0.0


def _local_moves(arcs: DataFrame, labels: DataFrame, iterations: int, tolerance: float, resolution: float) -> tuple[DataFrame, float]:
    """Nodes move to the neighbouring community with most gain, half of them in a round.

    The halves are drawn by a hash, so that neighbours don't swap; a round that
    doesn't raise the modularity by ``tolerance`` is undone, and ends it when
    both halves had their turn.
    """
    best = _quality(arcs, labels, resolution)
    weight = written(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
    total = weight.agg(F.sum("k")).first()[0] or 0.0
    idle = 0
    for r in range(2 * iterations):
        if not total or idle == 2:
            break
        volume = labels.join(weight, "id", "left").groupBy("c").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("vol"))
        links = arcs.filter("src <> dst").join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("to"))
        here = labels.join(weight, "id").filter(F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2)
        options = (
            here.withColumnRenamed("c", "own")
            .join(links.unionByName(here.select("id", "c", F.lit(0.0).alias("to"))).groupBy("id", "c").agg(F.sum("to").alias("to")), "id")
            .join(volume, "c")
        )
        without = F.col("vol") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("to") - resolution * F.col("k") * without / total
        # Among equal gains a node stays, else the least label wins.
        choice = F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("c") == F.col("own")).cast("int").alias("stay"), (-F.col("c")).alias("low"))).alias("m")
        moved = options.groupBy("id").agg(choice).select("id", (-F.col("m.low")).alias("n"))
        after = written(labels.join(moved, "id", "left").select("id", F.coalesce("n", "c").alias("c")), "labels")
        value = _quality(arcs, after, resolution)
        if value > best + tolerance:
            labels, best, idle = after, value, 0
        else:
            idle += 1
    return labels, best


def _symmetric(p: Projected) -> DataFrame:
    """Arcs both ways with their weights; a loop counts for both of its ends."""
    if not p.directed:
        return written(p.arcs.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w")).alias("w")), "sym")
    back = p.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return written(p.arcs.union(back).groupBy("src", "dst").agg(F.sum("w").alias("w")), "sym")


def _contracted(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    c = labels.select("id", "c")
    both = arcs.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")
    return written(both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "sym")


def _levels(p: Projected, levels: int, iterations: int, tolerance: float, resolution: float, refine: bool) -> DataFrame:
    """id, community_id, levels: an array with the community after each level."""
    arcs = _symmetric(p)
    member = written(p.nodes.select("id", F.col("id").alias("at"), F.array().cast("array<bigint>").alias("levels")), "members")
    start = None
    last = None
    for _ in range(levels):
        ids = member.select(F.col("at").alias("id")).distinct()
        labels = written(ids.withColumn("c", F.col("id")) if start is None else ids.join(start, "id"), "labels")
        labels, value = _local_moves(arcs, labels, iterations, tolerance, resolution)
        if last is not None and value <= last + tolerance:
            break
        last = value
        group = labels
        if refine:
            # Communities are split into their connected parts; the parts are the next level's
            # nodes and start in their community, named by its first part.
            c = labels.select("id", "c")
            inner = arcs.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").filter("a = b and src <> dst")
            part = connected_components(inner.select("src", "dst"))
            group = written(labels.join(part, "id", "left").select("id", F.coalesce("component", "id").alias("c"), F.col("c").alias("whole")), "parts")
            first = group.groupBy("whole").agg(F.min("c").alias("name"))
            start = written(group.select(F.col("c").alias("id"), "whole").distinct().join(first, "whole").select("id", F.col("name").alias("c")), "start")
        merged = member.join(group.select(F.col("id").alias("at"), F.col("c").alias("next")), "at")
        shown = labels.select(F.col("id").alias("at"), F.col("c").alias("shown"))
        member = written(merged.join(shown, "at").select("id", F.col("next").alias("at"), F.concat("levels", F.array("shown")).alias("levels"), "shown"), "members").select("id", "at", "levels")
        before = arcs
        arcs = _contracted(arcs, group)
        if arcs.count() == before.count() and not refine:
            break
    final = F.coalesce(F.element_at("levels", -1), F.col("id")) if last is not None else F.col("id")
    out = member.select("id", final.alias("community_id"), "levels")
    if refine:
        # A community that a later level left in parts is returned in those parts.
        c = written(out.select("id", F.col("community_id").alias("c"), "levels"), "final")
        sym = _symmetric(p)
        inner = sym.join(c.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b and src <> dst")
        part = connected_components(inner.select("src", "dst"))
        return c.join(part, "id", "left").select("id", F.coalesce("component", "id").alias("community_id"), "levels")
    return out


def _named_levels(p: Projected, levels: int, iterations: int, tolerance: float, resolution: float, refine: bool) -> DataFrame:
    p, names = numbered(p)
    out = _levels(p, levels, iterations, tolerance, resolution, refine)
    if names is None:
        return out
    return names.of(names.of(names.of_arrays(written(out, "levels"), "levels"), "community_id"), "id")


def louvain(p: Projected, levels: int = 10, iterations: int = 10, tolerance: float = 1e-4, resolution: float = 1.0, intermediate: bool = False) -> DataFrame:
    """id, community_id and, if asked for, intermediate_community_ids."""
    check_louvain_options(levels, iterations, tolerance)
    out = _named_levels(p, levels, iterations, tolerance, resolution, refine=False)
    return out.withColumnRenamed("levels", "intermediate_community_ids") if intermediate else out.drop("levels")


def check_louvain_options(levels: int, iterations: int, tolerance: float) -> None:
    if levels <= 0 or iterations <= 0:
        raise ValueError("levels and iterations are positive")
    if tolerance < 0:
        raise ValueError("a tolerance isn't negative")


def leiden(p: Projected, levels: int = 10, iterations: int = 10, tolerance: float = 1e-4, resolution: float = 1.0, intermediate: bool = False) -> DataFrame:
    """As :func:`louvain`, and every community is connected."""
    check_louvain_options(levels, iterations, tolerance)
    out = _named_levels(p, levels, iterations, tolerance, resolution, refine=True)
    return out.withColumnRenamed("levels", "intermediate_community_ids") if intermediate else out.drop("levels")


def modularity_optimization(p: Projected, iterations: int = 10, tolerance: float = 1e-4, resolution: float = 1.0) -> DataFrame:
    """id, community_id: the moves of one level."""
    p, names = numbered(p)
    arcs = _symmetric(p)
    labels, _ = _local_moves(arcs, written(p.nodes.select("id", F.col("id").alias("c")), "labels"), iterations, tolerance, resolution)
    out = labels.select("id", F.col("c").alias("community_id"))
    return out if names is None else names.of(names.of(out, "community_id"), "id")


def max_k_cut(p: Projected, k: int = 2, iterations: int = 8) -> DataFrame:
    """id, community_id of 0 to k - 1: nodes move to the part with least weight to them.

    Starts from a hash; half of the nodes move in a round, and a round that
    doesn't cut more is undone.
    """
    if k < 2:
        raise ValueError("a cut has 2 parts at least")
    arcs = written(p.both_ways(), "sym")

    def cut(labels: DataFrame) -> float:
        both = arcs.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").filter("a <> b")
        return both.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] / 2

    labels = written(p.nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(k)).alias("c")), "labels")
    best = cut(labels)
    parts = p.spark.range(k).withColumnRenamed("id", "c")
    idle = 0
    for r in range(2 * iterations):
        if idle == 2:
            break
        held = arcs.join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
        turn = labels.filter(F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == r % 2)
        options = turn.withColumnRenamed("c", "own").join(F.broadcast(parts), F.lit(True)).join(held, ["id", "c"], "left")  # k rows
        choice = F.min(F.struct(F.coalesce("w", F.lit(0.0)).alias("w"), (F.col("c") != F.col("own")).alias("moves"), "c")).alias("m")
        moved = options.groupBy("id").agg(choice).select("id", F.col("m.c").alias("n"))
        after = written(labels.join(moved, "id", "left").select("id", F.coalesce("n", "c").alias("c")), "labels")
        if (value := cut(after)) > best:
            labels, best, idle = after, value, 0
        else:
            idle += 1
    return labels.select("id", F.col("c").alias("community_id"))
