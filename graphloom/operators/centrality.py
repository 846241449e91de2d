"""Centrality: how much a node matters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import kernels
from graphloom.operators.paths import all_distances
from graphloom.operators.projection import Projected, loop, numbered, written
from graphloom.plans.lineage import scratch

DAMPING, ITERATIONS, TOLERANCE = 0.85, 20, 1e-7


def degree(p: Projected) -> DataFrame:
    """id, score: the number of arcs from a node, or the sum of their weights."""
    own = p.arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("score"))
    return p.nodes.join(own, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _out_weight(p: Projected) -> DataFrame:
    return p.arcs.groupBy("src").agg(F.sum("w").alias("out"))


def _rank(p: Projected, shares: DataFrame, damping: float, iterations: int, tolerance: float | None) -> DataFrame:
    """Repeated s(v) = 1 - d + d * sum of s(u) * share(u, v).

    The arcs with their shares are written once; a round is one join and one
    aggregation with partial sums.  With a tolerance it stops when no score
    moved by more.
    """
    flows = written(shares, "flows")
    nodes = p.nodes

    def step(scores: DataFrame) -> DataFrame:
        sent = flows.join(scores, flows.src == scores.id).groupBy(F.col("dst").alias("at")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        return nodes.join(sent, nodes.id == sent["at"], "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))

    start = nodes.select("id", F.lit(1 - damping).alias("score"))
    if tolerance is None:
        return loop(start, step, iterations, "scores")
    now = written(start, "scores")
    for _ in range(iterations):
        after = written(step(now), "scores")
        moved = now.join(after.withColumnRenamed("score", "after"), "id").agg(F.max(F.abs(F.col("score") - F.col("after")))).first()[0]
        now = after
        if moved is None or moved <= tolerance:
            break
    return now


def pagerank(p: Projected, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """id, score.  Not normalised; what nodes without arcs hold is not dealt out."""
    check_rank_options(damping, iterations, tolerance)
    out = _out_weight(p).filter("out > 0")
    return _rank(p, p.arcs.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), damping, iterations, tolerance)


def check_rank_options(damping: float, iterations: int, tolerance: float | None) -> None:
    if not 0 <= damping < 1:
        raise ValueError("damping lies in [0, 1)")
    if iterations <= 0:
        raise ValueError("iterations are positive")
    if tolerance is not None and tolerance < 0:
        raise ValueError("a tolerance isn't negative")


def article_rank(p: Projected, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """id, score: PageRank whose shares are w / (out + average out), so that few arcs count less."""
    check_rank_options(damping, iterations, tolerance)
    out = _out_weight(p)
    n = p.nodes.count()
    mean = (out.agg(F.coalesce(F.sum("out"), F.lit(0.0))).first()[0] / n) if n else 0.0
    shares = p.arcs.join(out, "src").filter(F.col("out") + mean > 0).select("src", "dst", (F.col("w") / (F.col("out") + mean)).alias("share"))
    return _rank(p, shares, damping, iterations, tolerance)


def _normalised(scores: DataFrame, *columns: str) -> DataFrame:
    """Each column divided by its root of the sum of squares (left as it is where that is 0)."""
    norms = scores.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"norm_{c}") for c in columns))
    kept = [c for c in scores.columns if c not in columns]
    return scores.crossJoin(F.broadcast(norms)).select(  # one row
        *kept, *(F.when(F.col(f"norm_{c}") > 0, F.col(c) / F.col(f"norm_{c}")).otherwise(F.col(c)).alias(c) for c in columns)
    )


def eigenvector(p: Projected, iterations: int = ITERATIONS) -> DataFrame:
    """id, score: power iteration of (A + 1) on incoming arcs, length one in each round."""
    arcs, nodes = p.arcs, p.nodes

    def step(scores: DataFrame) -> DataFrame:
        got = arcs.join(scores, arcs.src == scores.id).select(F.col("dst").alias("id"), (F.col("score") * F.col("w")).alias("part"))
        added = got.union(scores.select("id", "score")).groupBy("id").agg(F.sum("part").alias("score"))
        return written(_normalised(written(added, "scores"), "score"), "scores")

    scores = written(_normalised(nodes.select("id", F.lit(1.0).alias("score")), "score"), "scores")
    for _ in range(iterations):
        scores = step(scores)
    return scores


def hits(p: Projected, iterations: int = ITERATIONS) -> DataFrame:
    """id, auth, hub and values, a map of both; each of length one."""
    arcs, nodes = p.arcs, p.nodes
    scores = written(nodes.select("id", F.lit(1.0).alias("auth"), F.lit(1.0).alias("hub")), "scores")
    for _ in range(iterations):
        auth = arcs.join(scores, arcs.src == scores.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hub") * F.col("w")).alias("auth"))
        authed = written(_normalised(written(nodes.join(auth, "id", "left").select("id", F.coalesce("auth", F.lit(0.0)).alias("auth")), "auth"), "auth"), "auth")
        hub = arcs.join(authed, arcs.dst == authed.id).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("auth") * F.col("w")).alias("hub"))
        scores = written(_normalised(written(authed.join(hub, "id", "left").select("id", "auth", F.coalesce("hub", F.lit(0.0)).alias("hub")), "hub"), "hub"), "scores")
    return scores.withColumn("values", F.create_map(F.lit("auth"), "auth", F.lit("hub"), "hub"))


#: Sources whose distances to all nodes are held at once, about.
SOURCES = 20_000


def _batches(p: Projected, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``run`` for all nodes as sources, so many at a time: distances are a row for each source and node."""
    parts = -(-p.nodes.count() // SOURCES)
    if parts <= 1:
        return run(p.nodes)
    out = []
    for k in range(parts):
        own = p.nodes.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        with scratch(p.spark) as kept:
            out.append(kept(run(own), "batch"))
    return reduce(DataFrame.union, out)


def closeness(p: Projected, weighted: bool = False) -> DataFrame:
    """id, score: nodes reached / sum of the distances to them; 0 if none is.

    By hops it is found in tasks, where a batch of nodes is bits; see :mod:`kernels`.
    """

    def run(sources: DataFrame) -> DataFrame:
        far = all_distances(p, weighted=weighted, sources=sources).filter("id <> source")
        return far.groupBy(F.col("source").alias("id")).agg((F.count("*") / F.sum("dist")).alias("score"))

    if weighted or not kernels.fits(p):
        own = _batches(p, run)
    else:
        own = kernels.hops(p).select("id", (F.col("reached") / F.col("total")).alias("score"))
    return p.nodes.join(own, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def harmonic(p: Projected) -> DataFrame:
    """id, score: sum of 1 / distance to every node reached, over the number of other nodes."""
    n = p.nodes.count()

    def run(sources: DataFrame) -> DataFrame:
        far = all_distances(p, sources=sources).filter("id <> source")
        return far.groupBy(F.col("source").alias("id")).agg(F.sum(1.0 / F.col("dist")).alias("total"))

    own = kernels.hops(p).select("id", F.col("inverse").alias("total")) if kernels.fits(p) else _batches(p, run)
    return p.nodes.join(own, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) / max(n - 1, 1)).alias("score"))


def betweenness(p: Projected, weighted: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """id, score: Brandes' dependencies summed over all sources, or over those given.

    Distances from every source fix the arcs of shortest paths; path counts go
    forward and dependencies back along these arcs, by number of hops, until
    none is left.  Undirected pairs are counted once.  By hops and for all
    sources it is done in tasks, a batch of sources at a time.
    """
    if sources is None and not weighted and kernels.fits(p):
        own = kernels.dependencies(p)
    elif sources is None:
        own = _batches(p, lambda some: _dependencies(p, weighted, some)).groupBy("id").agg(F.sum("score").alias("score"))
    else:
        own = _dependencies(p, weighted, sources)
    half = 1.0 if p.directed else 0.5
    return p.nodes.join(own, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * half).alias("score"))


def _dependencies(p: Projected, weighted: bool, sources: DataFrame) -> DataFrame:
    """id, score: what sources depend on a node for, summed."""
    dist = written(all_distances(p, weighted=weighted, sources=sources), "dist")
    arcs = p.arcs.filter("src <> dst")
    step = F.col("w") if weighted else F.lit(1.0)
    on = (
        dist.select("source", F.col("id").alias("u"), F.col("dist").alias("du"))
        .join(arcs, F.col("u") == F.col("src"))
        .join(dist.select(F.col("source").alias("s2"), F.col("id").alias("v"), F.col("dist").alias("dv")), (F.col("source") == F.col("s2")) & (F.col("dst") == F.col("v")))
        .filter(F.abs(F.col("du") + step - F.col("dv")) < 1e-9)
        .select("source", "u", "v")
    )
    dag = written(on, "dag")

    def spread(start: DataFrame, move) -> DataFrame:
        layers, now = [start], start
        while True:
            now = written(move(now), "layer")
            if now.isEmpty():
                break
            layers.append(now)
        return written(reduce(DataFrame.union, layers).groupBy("source", "id").agg(F.sum("x").alias("x")), "spread")

    def forward(now: DataFrame) -> DataFrame:
        n = now.select(F.col("source").alias("s2"), F.col("id").alias("at"), "x")
        return dag.join(n, (F.col("source") == F.col("s2")) & (F.col("u") == F.col("at"))).groupBy("source", F.col("v").alias("id")).agg(F.sum("x").alias("x"))

    counts = spread(dist.filter("id = source").select("source", "id", F.lit(1.0).alias("x")), forward)
    c = counts.select(F.col("source").alias("s2"), F.col("id").alias("node"), F.col("x").alias("paths"))
    shares = dag.join(c, (F.col("source") == F.col("s2")) & (F.col("u") == F.col("node"))).select("source", "u", "v", F.col("paths").alias("pu"))
    shares = shares.join(c, (F.col("source") == F.col("s2")) & (F.col("v") == F.col("node"))).select("source", "u", "v", (F.col("pu") / F.col("paths")).alias("share"))
    shares = written(shares, "shares")

    def backward(now: DataFrame) -> DataFrame:
        n = now.select(F.col("source").alias("s2"), F.col("id").alias("at"), "x")
        return shares.join(n, (F.col("source") == F.col("s2")) & (F.col("v") == F.col("at"))).groupBy("source", F.col("u").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))

    first = shares.groupBy("source", F.col("u").alias("id")).agg(F.sum("share").alias("x"))
    depends = spread(written(first, "layer"), backward)
    return depends.filter("id <> source").groupBy("id").agg(F.sum("x").alias("score"))


def celf(p: Projected, seeds: int = 3, probability: float = 0.1, simulations: int = 20, seed: int = 42, weighted: bool = False) -> DataFrame:
    """id, spread: the seeds chosen greedily under independent cascades, with the spread after each.

    Whether an arc passes an influence in a simulation is a hash of the arc,
    the simulation and the seed, so every run agrees.  How many nodes each node
    reaches is counted in tasks, where a batch of nodes is bits; what a chosen
    seed reaches is then taken out of its simulation, which leaves the gains of
    the others.  Greedy choice needs no more evaluations than its lazy form,
    since all gains come from one count.
    """
    spark = p.spark
    chance = F.least(F.lit(1.0), F.col("w")) if weighted else F.lit(probability)
    runs = spark.range(simulations).withColumnRenamed("id", "run")  # a stated number of rows
    coin = F.pmod(F.xxhash64("src", "dst", "run", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    live = p.arcs.filter("src <> dst").join(F.broadcast(runs), F.lit(True)).filter(coin < chance).select("run", "src", "dst")
    if not kernels.fits(p):
        return _celf_by_joins(p, written(live, "live"), runs, seeds, simulations)
    q, names = numbered(p)
    if names:
        a, b = names.names.toDF("a", "src"), names.names.toDF("b", "dst")
        live = live.join(a, "src").join(b, "dst").select("run", F.col("a").alias("src"), F.col("b").alias("dst"))
    live = written(live, "live")
    covered = None
    chosen, total = [], 0.0
    for _ in range(seeds):
        gain = q.nodes.join(kernels.spreads(live), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + simulations).alias("n"))
        if covered is not None:
            lost = covered.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("lost"))
            gain = gain.join(lost, "id", "left").select("id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
        best = gain.filter("n > 0").orderBy(F.desc("n"), "id").first()
        if best is None:
            break
        total += best.n / simulations
        chosen.append((best.id, float(total)))
        if len(chosen) == seeds:
            break
        own = runs.select("run", F.lit(best.id).cast("long").alias("at"))
        more = kernels.cascade(live, best.id).union(own if covered is None else own.join(covered, ["run", "at"], "left_anti"))
        covered = written(more if covered is None else covered.union(more), "covered")
        gone = covered.withColumnRenamed("at", "src"), covered.withColumnRenamed("at", "dst")
        live = written(live.join(gone[0], ["run", "src"], "left_anti").join(gone[1], ["run", "dst"], "left_anti").select("run", "src", "dst"), "live")
    kind = p.nodes.schema["id"].dataType.simpleString()
    if not names:
        return spark.createDataFrame(chosen, f"id {kind}, spread double")
    return names.of(spark.createDataFrame(chosen, "id bigint, spread double"), "id")


def _celf_by_joins(p: Projected, live: DataFrame, runs: DataFrame, seeds: int, simulations: int) -> DataFrame:
    """The same with a row for each node, simulation and node reached, for arcs that don't fit a task."""
    spark = p.spark
    reach = written(p.nodes.join(F.broadcast(runs), F.lit(True)).select("run", F.col("id").alias("source"), F.col("id").alias("at")), "reach")
    front = reach
    while True:
        ahead = front.join(live.withColumnRenamed("run", "r2"), (F.col("run") == F.col("r2")) & (F.col("at") == F.col("src"))).select("run", "source", F.col("dst").alias("at")).distinct()
        front = written(ahead.join(reach, ["run", "source", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        reach = written(reach.union(front), "reach")
    chosen, total = [], 0.0
    for _ in range(seeds):
        best = reach.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()
        if best is None:
            break
        total += best.n / simulations
        chosen.append((best.source, float(total)))
        covered = reach.filter(F.col("source") == F.lit(best.source)).select("run", "at")
        reach = written(reach.join(covered, ["run", "at"], "left_anti"), "reach")
    kind = p.nodes.schema["id"].dataType.simpleString()
    return spark.createDataFrame(chosen, f"id {kind}, spread double")
