"""All-sources measures in tasks: many sources at once over arcs that a task holds.

Each task gets all arcs by a shuffle and a share of the ends; what it knows of
one batch of ends (a bit or a number for each end and node) is never a table.
Only totals for each node leave a task, so neither disk nor shuffle grows with
the number of pairs.  Graphs of more than ``MOST_ARCS`` arcs don't fit a task;
the callers then go by joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.projection import INTEGRAL, Numbering, Projected, Unsettled, numbered, written

#: Arcs that a task holds, at most.
MOST_ARCS = 8_000_000
#: Tasks that share the ends of a measure; each gets all arcs.
SHARES = 24
#: Bytes of what a task knows of one batch of ends.
STATE = 1 << 24


def fits(p: Projected) -> bool:
    """Whether the arcs fit a task."""
    return p.arcs.count() <= MOST_ARCS


class Arcs:
    """Arcs between the numbers 0.. of ``ids`` (sorted), by their start and by their end."""

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([src, dst]))
        self.n = len(self.ids)
        a, b = np.searchsorted(self.ids, src).astype(np.int32), np.searchsorted(self.ids, dst).astype(np.int32)
        self.out, self.out_at = self.by(a, b)
        self.into, self.into_at = self.by(b, a)

    def turned(self) -> Arcs:
        """The same nodes with every arc the other way."""
        back = object.__new__(Arcs)
        back.ids, back.n = self.ids, self.n
        back.out, back.out_at, back.into, back.into_at = self.into, self.into_at, self.out, self.out_at
        return back

    def by(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(a, kind="stable")
        return b[order], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))]).astype(np.int64)

    @staticmethod
    def ranges(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all arcs of some nodes, one node after another, and where each node's begin."""
        size = at[rows + 1] - at[rows]
        begin = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(at[rows] - begin, size), begin

    def towards(self, active: np.ndarray, ends: np.ndarray, at: np.ndarray, others: np.ndarray, other_at: np.ndarray, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with an arc to an active one; the active ones they have, node by node; where each node's begin.

        ``ends``, ``at`` give the arcs of a node that may be moved to; ``others``, ``other_at`` those of an active one.
        ``free`` says which nodes are asked for.
        """
        mask = np.zeros(self.n, dtype=bool)
        mask[others[self.ranges(other_at, active)[0]]] = True
        if free is not None:
            mask &= free
        rows = np.flatnonzero(mask)
        places, begin = self.ranges(at, rows)
        mask[:] = False
        mask[active] = True
        heads = ends[places]
        hit = mask[heads]
        size = np.add.reduceat(hit, begin, dtype=np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
        return rows, heads[hit], np.cumsum(size) - size


def reached(arcs: Arcs, targets: np.ndarray, gather: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Level by level, ``gather(level, nodes, counts)``: how many targets lie so many hops from a node.

    ``targets`` are numbers; a node knows them as bits, and new bits go back
    along the arcs until there are none.
    """
    words = -(-len(targets) // 64)
    seen = np.zeros((arcs.n, words), dtype=np.uint64)
    bit = np.arange(len(targets))
    seen[targets, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    _onward(arcs, seen, targets, seen[targets], gather)


def _onward(arcs: Arcs, seen: np.ndarray, active: np.ndarray, front: np.ndarray, gather: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """The levels of :func:`reached` after one whose new bits are ``front``, at the nodes ``active``."""
    place = np.zeros(arcs.n, dtype=np.int64)
    level = 0
    while len(active):
        level += 1
        rows, heads, begin = arcs.towards(active, arcs.out, arcs.out_at, arcs.into, arcs.into_at)
        if not len(rows):
            return
        place[active] = np.arange(len(active))
        new = np.bitwise_or.reduceat(front[place[heads]], begin, axis=0)
        old = seen[rows]
        new &= ~old
        counts = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        some = counts > 0
        active, front, counts = rows[some], new[some], counts[some]
        seen[active] |= front
        gather(level, active, counts)


def batches(n: int, share: int, shares: int, most: int) -> Iterator[np.ndarray]:
    """Neighbouring numbers below ``n``, so many at a time, that fall to one share."""
    size = max(1, min(most, -(-n // shares)))
    for k in range(share, -(-n // size), shares):
        yield np.arange(k * size, min(n, (k + 1) * size))


def _words(n: int) -> int:
    """Bits of a batch, by the number of nodes."""
    return 64 * max(1, min(32, STATE // (8 * max(n, 1))))


def _own(table: pa.Table) -> Arcs:
    return Arcs(table["src"].to_numpy(), table["dst"].to_numpy())


def _shared(arcs: DataFrame, shares: int) -> DataFrame:
    """share, src, dst: all arcs for each share."""
    own = arcs.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    # Shares are few; with more partitions hardly any two of them meet in one.
    return own.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(4 * shares, "share")


def _keyed(df: DataFrame, p: Projected, names: Numbering | None) -> DataFrame:
    """``df`` with the graph's own keys."""
    return names.of(df, "id") if names else df.withColumn("id", F.col("id").cast(p.nodes.schema["id"].dataType))


def hops(p: Projected) -> DataFrame:
    """id, reached, total, inverse: other nodes reached, the sum of their hops, and of the hops' inverses."""

    def run(table: pa.Table) -> pa.Table:
        arcs, share = _own(table), int(table["share"][0].as_py())
        count, total, inverse = np.zeros(arcs.n, dtype=np.int64), np.zeros(arcs.n, dtype=np.int64), np.zeros(arcs.n)

        def gather(level: int, nodes: np.ndarray, counts: np.ndarray) -> None:
            count[nodes] += counts
            total[nodes] += level * counts
            inverse[nodes] += counts / level

        for some in batches(arcs.n, share, SHARES, _words(arcs.n)):
            reached(arcs, some, gather)
        any_ = count > 0
        return pa.table({"id": arcs.ids[any_], "reached": count[any_], "total": total[any_], "inverse": inverse[any_]})

    q, names = numbered(p)
    found = _shared(q.arcs, SHARES).groupBy("share").applyInArrow(run, "id bigint, reached bigint, total bigint, inverse double")
    sums = found.groupBy("id").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.sum("inverse").alias("inverse"))
    return _keyed(sums, p, names)


# --- Brandes' dependencies, block by block ---------------------------------------------

#: Parts of the whole work by which blocks are dealt to shares, for each share.
PARTS = 4
#: Arcs of small blocks that are searched together.
TOGETHER = 1 << 14


def dependencies(p: Projected) -> DataFrame:
    """id, score: Brandes' dependencies by hops, summed over all sources.

    Where one node parts the graph (arcs taken either way), every route from
    one side to the other goes through it.  So each block is searched by
    itself: a cut node of it stands, as a source, for the nodes beyond it that
    reach it, and as a target for those that it reaches.  What a cut node gets
    for routes between its blocks is a product of such numbers.
    """
    q, names = numbered(p)
    whole = q.arcs.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    kind = "src bigint, dst bigint, block int, first int, many int, pairs int"
    dealt = written(whole.groupBy().applyInArrow(_blocked, kind).repartition(SHARES), "blocks")
    rows = dealt.filter("many > 0").select("block", "first", "many", "src", "dst", *(F.lit(None).cast("double").alias(c) for c in ("ins", "outs")))
    joints = None
    if pairs := dealt.agg(F.max("pairs")).first()[0]:
        # A share has a word of bits to search for, at least.
        shares = min(SHARES, -(-pairs // 64))
        every = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("shares", F.lit(shares)).repartition(4 * SHARES, "share")
        joints = written(every.groupBy("share").applyInArrow(_beyond, "id bigint, block int, first int, many int, ins double, outs double"), "joints")
        other = lambda c: (F.sum(c).over(Window.partitionBy("id")) - F.col(c) + 1.0).alias(c)
        rows = rows.union(joints.select("block", "first", "many", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), other("ins"), other("outs")).filter("many > 0"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("share", F.pmod(F.col("first") + F.col("part"), F.lit(SHARES)))
    found = rows.drop("first").repartition(4 * SHARES, "share").groupBy("share").applyInArrow(_within, "id bigint, score double")
    if joints is not None:
        between = joints.groupBy("id").agg((F.sum("ins") * F.sum("outs") - F.sum(F.col("ins") * F.col("outs"))).alias("score"))
        found = found.union(between)
    return _keyed(found.groupBy("id").agg(F.sum("score").alias("score")), p, names)


def _found(arcs: Arcs) -> tuple[np.ndarray, np.ndarray]:
    """When a depth-first search finds each node, and the block of the arc that finds it, named by its first such node (-1: none).

    Arcs are taken either way; a block is a largest part that no single node
    parts.  The block of any arc is that of its end which is found later.
    """
    n = arcs.n
    tails = [np.repeat(np.arange(n, dtype=np.int32), np.diff(at)) for at in (arcs.out_at, arcs.into_at)]
    ends, at = arcs.by(np.concatenate(tails), np.concatenate([arcs.out, arcs.into]))
    heads, todo, last = memoryview(ends), at[:-1].tolist(), at[1:].tolist()
    when, parent, order = [-1] * n, [-1] * n, []
    for root in range(n):
        if when[root] >= 0:
            continue
        node, when[root] = root, len(order)
        order.append(root)
        while node >= 0:
            i, end = todo[node], last[node]
            while i < end and when[heads[i]] >= 0:
                i += 1
            todo[node] = i
            if i < end:
                ahead = heads[i]
                parent[ahead], when[ahead] = node, len(order)
                order.append(ahead)
                node = ahead
            else:
                node = parent[node]
    found = np.array(when, dtype=np.int64)
    # The first found node that a node or what was found through it has an arc with.
    least = np.minimum.reduceat(found[ends], at[:-1]).tolist() if n else []
    for node in reversed(order):
        up = parent[node]
        if up >= 0 and least[node] < least[up]:
            least[up] = least[node]
    block = [-1] * n
    for node in order:
        if (up := parent[node]) >= 0:
            block[node] = node if least[node] >= when[up] else block[up]
    return found, np.array(block, dtype=np.int32)


def _blocked(table: pa.Table) -> pa.Table:
    """src, dst, block, first, many, pairs: the arcs with their blocks; shares ``first``, ``first`` + 1, ... (``many`` of them) search a block.

    ``pairs`` counts cut nodes with each of their blocks.
    """
    src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
    arcs = Arcs(src, dst)
    a, b = np.searchsorted(arcs.ids, src), np.searchsorted(arcs.ids, dst)
    found, tops = _found(arcs)
    block = tops[np.where(found[a] > found[b], a, b)]
    nodes = np.bincount(tops[tops >= 0], minlength=arcs.n) + 1.0
    # Of two nodes none lies between others.
    work = np.where(nodes > 2, nodes * np.bincount(block, minlength=arcs.n), 0.0)
    many = np.minimum(np.ceil(work * (PARTS * SHARES / max(work.sum(), 1.0))), np.minimum(SHARES, nodes)).astype(np.int32)
    first = ((np.cumsum(many) - many) % SHARES).astype(np.int32)
    pairs = np.full(len(src), len(_cut(arcs.n, a, b, block, arcs.n)), dtype=np.int32)
    return pa.table({"src": src, "dst": dst, "block": block, "first": first[block], "many": many[block], "pairs": pairs})


def _cut(n: int, a: np.ndarray, b: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """Nodes of several blocks with each of these, as node * ``k`` + block."""
    pairs = np.unique(np.concatenate([a * k + block, b * k + block]))
    return pairs[np.bincount(pairs // k, minlength=n)[pairs // k] > 1]


def _beyond(table: pa.Table) -> pa.Table:
    """id, block, first, many, ins, outs: for each cut node and block of it, how many nodes reach it, and it reaches, through that block.

    A search from a cut node whose first step is within the block never leaves
    that side, as it doesn't go through the node again.
    """
    arcs, share, shares = _own(table), int(table["share"][0].as_py()), int(table["shares"][0].as_py())
    a, b = (np.searchsorted(arcs.ids, table[c].to_numpy()) for c in ("src", "dst"))
    names, first_at, block = np.unique(table["block"].to_numpy(), return_index=True, return_inverse=True)
    k = len(names)
    pairs = _cut(arcs.n, a, b, block, k)
    sides = [(arcs, a, b), (arcs.turned(), b, a)]
    counts = np.zeros((2, len(pairs)))
    mine = np.zeros(len(pairs), dtype=bool)
    for some in batches(len(pairs), share, shares, _words(arcs.n)):
        mine[some] = True
        for side, (way, tail, head) in enumerate(sides):
            counts[side, some] = _through(way, tail, head * k + block, pairs[some], pairs[some] // k)
    own = pairs[mine] % k
    plan = {c: table[c].to_numpy()[first_at[own]] for c in ("first", "many")}
    return pa.table({"id": arcs.ids[pairs[mine] // k], "block": names[own], **plan, "ins": counts[0, mine], "outs": counts[1, mine]})


def _through(arcs: Arcs, tail: np.ndarray, heads: np.ndarray, keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """How many other nodes reach each of ``nodes`` by an arc whose entry in ``heads`` is the node's key; keys are sorted."""
    seen = np.zeros((arcs.n, -(-len(keys) // 64)), dtype=np.uint64)
    bit = np.arange(len(keys))
    flag = np.uint64(1) << (bit % 64).astype(np.uint64)
    at = np.minimum(np.searchsorted(keys, heads), len(keys) - 1)
    step = np.flatnonzero(keys[at] == heads)
    np.bitwise_or.at(seen, (tail[step], at[step] // 64), flag[at[step]])
    active = np.unique(tail[step])
    front = seen[active]
    np.bitwise_or.at(seen, (nodes, bit // 64), flag)
    _onward(arcs, seen, active, front, lambda *_: None)
    total = np.zeros(seen.shape[1] * 64, dtype=np.int64)
    for cut in range(0, arcs.n, 4096):
        total += np.unpackbits(seen[cut : cut + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total[: len(keys)] - 1


def _within(table: pa.Table) -> pa.Table:
    """id, score: the dependencies within the blocks of a share."""
    arc = table["dst"].is_valid().to_numpy()
    joints = table.filter(pa.array(~arc))
    src, dst, block = (table[c].to_numpy() if arc.all() else table[c].filter(pa.array(arc)).to_numpy() for c in ("src", "dst", "block"))
    names, first, size = np.unique(block, return_index=True, return_counts=True)
    at = np.flatnonzero(arc)[first]
    many, part = (table[c].take(pa.array(at)).to_numpy() for c in ("many", "part"))
    del table, arc
    of_joint = np.searchsorted(names, joints["block"].to_numpy())
    order = np.argsort(block, kind="stable") if len(names) > 1 else np.arange(len(block), dtype=np.int32)
    start = np.cumsum(size) - size
    out = []
    for group in _groups(size, many):
        rows = np.concatenate([order[start[k] : start[k] + size[k]] for k in group])
        mine = np.flatnonzero(np.isin(of_joint, group))
        at_joint, joint = np.searchsorted(group, of_joint[mine]), joints["src"].to_numpy()[mine]
        # A node of several blocks is one for each; those of a block are neighbours.
        ids = np.unique(np.concatenate([src[rows], dst[rows]]))
        base = np.repeat(np.arange(len(group)) * len(ids), size[group]) if len(group) > 1 else 0
        arcs = Arcs(np.searchsorted(ids, src[rows]) + base, np.searchsorted(ids, dst[rows]) + base)
        del rows, base
        ins, outs, score = np.ones(arcs.n), np.ones(arcs.n), np.zeros(arcs.n)
        at = np.searchsorted(arcs.ids, at_joint * len(ids) + np.searchsorted(ids, joint))
        ins[at], outs[at] = joints["ins"].to_numpy()[mine], joints["outs"].to_numpy()[mine]
        of = arcs.ids // len(ids)
        nodes = np.bincount(of)
        rank = np.arange(arcs.n) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        most = max(8, min(128, STATE // (4 * arcs.n)))
        for some in batches(int(nodes.max()), int(part[group[0]]), int(many[group[0]]), most):
            chosen = np.flatnonzero((rank >= some[0]) & (rank <= some[-1]))
            _brandes(arcs, chosen, rank[chosen] - some[0], of, ins, outs, score)
        any_ = score > 0
        out.append(pa.table({"id": ids[arcs.ids[any_] % len(ids)], "score": score[any_]}))
    return pa.concat_tables(out)


def _groups(size: np.ndarray, many: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of so many arcs that are searched together, by rising numbers: small ones of about a size, any other alone."""
    group, total = [], 0
    for k in np.lexsort((size, many)):
        if group and (many[k] > 1 or total + size[k] > TOGETHER):
            yield np.sort(np.array(group))
            group, total = [], 0
        group.append(k)
        total += size[k]
    if group:
        yield np.sort(np.array(group))


def _brandes(arcs: Arcs, sources: np.ndarray, columns: np.ndarray, block: np.ndarray, ins: np.ndarray, outs: np.ndarray, score: np.ndarray) -> None:
    """Add what some sources depend on each node for: path counts forward by level, shares back.

    A column has a source of each block at most, which stands for ``ins`` of
    them; a target stands for ``outs``.  Blocks have no arcs with each other.
    """
    width = int(columns.max()) + 1
    weight = np.zeros((int(block[-1]) + 1, width))
    weight[block[sources], columns] = ins[sources]
    seen = np.zeros((arcs.n, width), dtype=bool)
    seen[sources, columns] = True
    paths = np.zeros((len(sources), width))
    paths[np.arange(len(sources)), columns] = 1.0
    place = np.zeros(arcs.n, dtype=np.int64)
    #: Nodes that some source hasn't come to.
    free = np.ones(arcs.n, dtype=bool)
    levels = [(sources, paths)]
    while True:
        active, paths = levels[-1]
        rows, heads, begin = arcs.towards(active, arcs.into, arcs.into_at, arcs.out, arcs.out_at, free)
        if not len(rows):
            break
        place[active] = np.arange(len(active))
        with np.errstate(over="raise"):  # more paths than a number holds
            new = _sums(paths, place[heads], begin)
        old = seen[rows]
        np.copyto(new, 0.0, where=old)
        here = new > 0
        some = here.any(axis=1)
        if not some.any():
            break
        old |= here
        seen[rows] = old
        free[rows] = ~old.all(axis=1)
        levels.append((rows, new) if some.all() else (rows[some], new[some]))
    depends = np.zeros_like(levels[-1][1])
    while len(levels) > 1:
        active, paths = levels.pop()
        score[active] += np.einsum("ij,ij->i", depends, weight[block[active]])
        share = outs[active][:, None] + depends
        np.divide(share, paths, out=share, where=paths > 0)
        np.copyto(share, 0.0, where=paths == 0)
        above, paths = levels[-1]
        depends = np.zeros_like(paths)
        mask = np.zeros(arcs.n, dtype=bool)
        mask[above] = True
        rows, heads, begin = arcs.towards(active, arcs.out, arcs.out_at, arcs.into, arcs.into_at, mask)
        place[active] = np.arange(len(active))
        got = _sums(share, place[heads], begin)
        place[above] = np.arange(len(above))
        mine = place[rows]
        depends[mine] = got * paths[mine]


#: Rows at a time, at least, that are added to as many others.
FEW = 8


def _sums(x: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` that ``rows`` names, from each of ``begin`` to the next; none is empty.

    The first ones of all sums are added, then the second ones, and so on:
    nothing larger than the result is made.
    """
    size = np.diff(begin, append=len(rows))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    total = x[rows[begin]]
    k, n = 1, int(np.searchsorted(-size, -1))
    while n > FEW:
        total[:n] += x[rows[begin[:n] + k]]
        k += 1
        n = int(np.searchsorted(-size, -k))
    for i in range(n):
        end = begin[i] + size[i]
        for cut in range(begin[i] + k, end, 1024):
            total[i] += x[rows[cut : min(end, cut + 1024)]].sum(axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


#: Tasks that share the nodes of one run of a cascade.
RUN_SHARES = 4


def spreads(live: DataFrame) -> DataFrame:
    """id, n: other nodes that a node reaches, summed over the runs of ``live`` (run, src, dst).

    A task has one run's arcs and a share of its nodes.
    """

    def run(table: pa.Table) -> pa.Table:
        arcs, share = _own(table), int(table["share"][0].as_py())
        count = np.zeros(arcs.n, dtype=np.int64)

        def gather(level: int, nodes: np.ndarray, counts: np.ndarray) -> None:
            count[nodes] += counts

        for some in batches(arcs.n, share, RUN_SHARES, _words(arcs.n)):
            reached(arcs, some, gather)
        any_ = count > 0
        return pa.table({"id": arcs.ids[any_], "n": count[any_]})

    own = live.select("run", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    own = own.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(RUN_SHARES - 1)))).repartition(SHARES * RUN_SHARES, "run", "share")
    found = own.groupBy("run", "share").applyInArrow(run, "id bigint, n bigint")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def cascade(live: DataFrame, seed: int) -> DataFrame:
    """run, at: what a seed reaches in each run, itself left out."""

    def run(table: pa.Table) -> pa.Table:
        arcs, name = _own(table), table["run"][0]
        found = np.flatnonzero(arcs.ids == seed)
        seen = np.zeros(arcs.n, dtype=bool)
        seen[found] = True
        front = found
        while len(front):
            ahead = np.unique(arcs.out[arcs.ranges(arcs.out_at, front)[0]])
            front = ahead[~seen[ahead]]
            seen[front] = True
        seen[found] = False
        at = arcs.ids[seen]
        return pa.table({"run": pa.array([name.as_py()] * len(at), pa.int64()), "at": at})

    own = live.select(F.col("run").cast("long").alias("run"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return own.groupBy("run").applyInArrow(run, "run bigint, at bigint")


# --- routes from sources -------------------------------------------------------------

#: Kinds of rows that a share gets.
ARC, SOURCE, TARGET, PLACE = range(4)
#: Kilometres.
EARTH_RADIUS = 6371.0
#: Rows that a task hands on at once, about, and nodes of paths in them.
HANDED, HANDED_NODES = 100_000, 4_000_000


def routable(p: Projected) -> bool:
    """Whether routes can be found in tasks: whole numbers as keys, and arcs that fit."""
    return isinstance(p.nodes.schema["id"].dataType, INTEGRAL) and fits(p)


def _dealt(p: Projected, sources: DataFrame, targets: DataFrame, places: DataFrame | None) -> DataFrame:
    """share, kind, src, dst, x, y: all arcs, targets and places for each share, and a share of the sources."""
    n = SHARES
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, kind: int, a: Column, b: Column = none, x: Column = F.lit(0.0), y: Column = F.lit(0.0)) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), a.cast("long").alias("src"), b.cast("long").alias("dst"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    ids = lambda df: df.select("id").filter("id is not null").distinct()
    whole = rows(p.arcs.filter("src <> dst"), ARC, F.col("src"), F.col("dst"), F.col("w")).union(rows(ids(targets), TARGET, F.col("id")))
    if places is not None:
        whole = whole.union(rows(places.filter("id is not null"), PLACE, F.col("id"), none, F.col("lat"), F.col("lon")))
    whole = whole.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = rows(ids(sources), SOURCE, F.col("id")).withColumn("share", F.pmod(F.xxhash64("src"), F.lit(n)).cast("int"))
    return whole.union(own).repartition(4 * n, "share")


class _Share:
    """What a share got: arcs by their start and then their end, with weights."""

    def __init__(self, parts: Iterator[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(list(parts))
        kind, src, x, y = (table[c].to_numpy() for c in ("kind", "src", "x", "y"))
        dst = table["dst"].fill_null(0).to_numpy()
        arc = kind == ARC
        a, b, w = src[arc], dst[arc], x[arc]
        self.ids = np.unique(np.concatenate([a, b]))
        self.n = len(self.ids)
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        order = np.lexsort((b, a))
        self.heads, self.w = b[order], w[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))]).astype(np.int64)
        self.sources = self._numbers(src[kind == SOURCE])
        self.wanted = np.zeros(self.n, dtype=bool)
        self.wanted[self._numbers(src[kind == TARGET])] = True
        self.places = np.full((self.n, 2), np.nan)
        place = kind == PLACE
        known = np.isin(src[place], self.ids)
        self.places[np.searchsorted(self.ids, src[place][known])] = np.stack([x[place][known], y[place][known]], axis=1)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of those keys that have arcs; the others have no route."""
        return np.searchsorted(self.ids, keys[np.isin(keys, self.ids)])

    def ahead(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the arcs of some nodes in their order, and which of them each arc is of."""
        places, _ = Arcs.ranges(self.at, front)
        return places, np.repeat(np.arange(len(front)), self.at[front + 1] - self.at[front])


def _by_hops(g: _Share, source: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of hops the nodes and the first paths to them in order (a row each)."""
    seen = np.zeros(g.n, dtype=bool)
    seen[source] = True
    front, paths = np.array([source]), np.array([[source]])
    while len(front) and (most is None or paths.shape[1] <= most):
        places, of = g.ahead(front)
        heads = g.heads[places]
        new = ~seen[heads]
        # Nodes of the front are in the order of their paths: the first arc to a node is on its first path.
        ends, first = np.unique(heads[new], return_index=True)
        order = np.argsort(first)
        front = ends[order]
        paths = np.concatenate([paths[of[new][first[order]]], front[:, None]], axis=1)
        seen[front] = True
        if len(front):
            yield front, paths


def _least(g: _Share, source: int, kept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Least (cost, hops) from a source to every node; a round extends what improved and is kept."""
    cost, hop = np.full(g.n, np.inf), np.full(g.n, np.iinfo(np.int32).max, dtype=np.int64)
    cost[source], hop[source] = 0.0, 0
    front, most = np.array([source]), rounds
    while len(front):
        if not rounds:
            raise Unsettled(f"routes didn't settle in {most} rounds")
        rounds -= 1
        places, of = g.ahead(front)
        heads, c, h = g.heads[places], cost[front][of] + g.w[places], hop[front][of] + 1
        better = (c < cost[heads]) | ((c == cost[heads]) & (h < hop[heads]))
        heads, c, h = heads[better], c[better], h[better]
        order = np.lexsort((h, c, heads))
        heads, c, h = heads[order], c[order], h[order]
        first = np.flatnonzero(np.diff(heads, prepend=-1))
        front = heads[first]
        cost[front], hop[front] = c[first], h[first]
        if kept is not None:
            front = front[kept(front, cost)]
    return cost, hop


def _least_paths(g: _Share, source: int, cost: np.ndarray, hop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of hops the nodes and, of the paths of least (cost, hops), the first in order."""
    front, paths = np.array([source]), np.array([[source]])
    while len(front):
        places, of = g.ahead(front)
        heads = g.heads[places]
        on = (hop[heads] == paths.shape[1]) & (cost[front][of] + g.w[places] == cost[heads])
        ends, first = np.unique(heads[on], return_index=True)
        order = np.argsort(first)
        front = ends[order]
        paths = np.concatenate([paths[of[on][first[order]]], front[:, None]], axis=1)
        if len(front):
            yield front, paths


def _towards_targets(g: _Share, scale: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which nodes may still lie on a least path to a target, by the distance over ground.

    A target is on the path to itself; for another node the bound to each target decides.
    """
    targets = np.flatnonzero(g.wanted)
    lat, lon = np.radians(g.places[:, 0]), np.radians(g.places[:, 1])

    def kept(front: np.ndarray, cost: np.ndarray) -> np.ndarray:
        out = g.wanted[front].copy()
        limit = cost[targets]
        for i in np.flatnonzero(~out):
            v = front[i]
            h = np.sin((lat[targets] - lat[v]) / 2) ** 2 + np.cos(lat[v]) * np.cos(lat[targets]) * np.sin((lon[targets] - lon[v]) / 2) ** 2
            far = np.nan_to_num(scale * 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h))), nan=0.0)
            out[i] = bool((cost[v] + far <= limit + 1e-9).any())
        return out

    return kept


def _rows(g: _Share, source: int, ends: np.ndarray, hop: np.ndarray, cost: np.ndarray, paths: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Routes from a source to those ends that are wanted, in batches of bounded size."""
    some = g.wanted[ends] & (ends != source)
    ends, hop, cost = ends[some], hop[some], cost[some]
    paths = None if paths is None else paths[some]
    step = HANDED if paths is None else max(1, min(HANDED, HANDED_NODES // paths.shape[1]))
    for k in range(0, len(ends), step):
        own = slice(k, k + step)
        m = len(ends[own])
        columns = {"source": np.full(m, g.ids[source]), "target": g.ids[ends[own]]}
        if paths is not None:
            width = paths.shape[1]
            columns["nodes"] = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(g.ids[paths[own]].ravel()))
        columns |= {"hop_count": hop[own].astype(np.int32), "total_cost": cost[own].astype(np.float64)}
        yield pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()})


def _routes(p: Projected, dealt: DataFrame, run: Callable[[_Share, int], Iterator[pa.RecordBatch]], nodes: bool, more: str = "") -> DataFrame:
    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Share(parts)
        for source in g.sources:
            yield from run(g, int(source))

    each.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "source bigint, target bigint, " + more + ("nodes array<bigint>, " if nodes else "") + "hop_count int, total_cost double"
    found = dealt.groupBy("share").applyInArrow(each, schema)
    kind = p.nodes.schema["id"].dataType.simpleString()
    casts = {"source": kind, "target": kind, "nodes": f"array<{kind}>"}
    return found.select(*(F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in found.columns))


def shortest_from(p: Projected, sources: DataFrame, targets: DataFrame, max_depth: int | None) -> DataFrame:
    """source, target, nodes, hop_count, total_cost: the first path with fewest hops."""

    def run(g: _Share, source: int) -> Iterator[pa.RecordBatch]:
        for ends, paths in _by_hops(g, source, max_depth):
            far = np.full(len(ends), paths.shape[1] - 1)
            yield from _rows(g, source, ends, far, far, paths)

    return _routes(p, _dealt(p, sources, targets, None), run, nodes=True)


def least_from(p: Projected, sources: DataFrame, targets: DataFrame, nodes: bool, rounds: int, places: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """source, target, nodes if asked for, hop_count, total_cost: the path of least (cost, hops), the first in order.

    With ``places`` (id, lat, lon) nodes are left out whose cost and distance over ground exceed every target's cost.
    It is written at once, so that a source that doesn't settle fails here.
    """

    bounded = places is not None

    def run(g: _Share, source: int) -> Iterator[pa.RecordBatch]:
        cost, hop = _least(g, source, _towards_targets(g, scale) if bounded else None, rounds)
        if nodes:
            for ends, paths in _least_paths(g, source, cost, hop):
                yield from _rows(g, source, ends, hop[ends], cost[ends], paths)
        else:
            ends = np.flatnonzero(np.isfinite(cost))
            yield from _rows(g, source, ends, hop[ends], cost[ends], None)

    try:
        return written(_routes(p, _dealt(p, sources, targets, places), run, nodes), "routes")
    except PythonException as e:
        if "didn't settle" in str(e):
            raise Unsettled(f"routes didn't settle in {rounds} rounds") from e
        raise


class _Walks:
    """The first walks from a source to each node by (cost, hops, nodes), so many for each node."""

    def __init__(self, g: _Share, source: int, many: int) -> None:
        # The walks of a round have as many hops and stand in the order of their nodes.
        self.heads, self.parents = [np.array([source])], [np.zeros(1, dtype=np.int64)]
        best = np.full((g.n, many), np.inf)
        #: round and place of each node's walks.
        self.turn, self.place = np.full((g.n, many), -1), np.zeros((g.n, many), dtype=np.int64)
        best[source, 0], self.turn[source, 0] = 0.0, 0
        costs = np.zeros(1)
        while len(costs):
            front = self.heads[-1]
            arcs, of = g.ahead(front)
            heads, c = g.heads[arcs], costs[of] + g.w[arcs]
            # Equal costs of fewer hops come first, so a new walk must cost less than the last one kept.
            some = np.flatnonzero(c < best[heads, -1])
            heads, c, of = heads[some], c[some], of[some]
            order = np.lexsort((c, heads))
            begin = np.flatnonzero(np.diff(heads[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            order = np.sort(order[rank < many])
            heads, c, of = heads[order], c[order], of[order]
            if not len(heads):
                break
            turn = len(self.heads)
            self.heads.append(heads)
            self.parents.append(of)
            nodes, where = np.unique(heads, return_inverse=True)
            # Old walks of these nodes and the new ones, cut to the first ones.
            all_node = np.concatenate([np.repeat(np.arange(len(nodes)), many), where])
            all_cost = np.concatenate([best[nodes].ravel(), c])
            all_turn = np.concatenate([self.turn[nodes].ravel(), np.full(len(c), turn)])
            all_place = np.concatenate([self.place[nodes].ravel(), np.arange(len(c))])
            order = np.lexsort((np.arange(len(all_node)), all_cost, all_node))
            begin = np.searchsorted(all_node[order], np.arange(len(nodes)))
            kept = order[(begin[:, None] + np.arange(many)[None, :]).ravel()]
            best[nodes] = all_cost[kept].reshape(-1, many)
            self.turn[nodes], self.place[nodes] = all_turn[kept].reshape(-1, many), all_place[kept].reshape(-1, many)
            costs = c
        self.cost = best

    def paths(self, turn: int, places: np.ndarray) -> np.ndarray:
        """The nodes of some walks of a round, a row each."""
        out = np.empty((len(places), turn + 1), dtype=np.int64)
        for t in range(turn, -1, -1):
            out[:, t] = self.heads[t][places]
            places = self.parents[t][places]
        return out


#: Walks for each node after which the simple ones among them are searched for pair by pair.
MOST_WALKS = 48


def _simple(paths: np.ndarray) -> np.ndarray:
    ordered = np.sort(paths, axis=1)
    return ~(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)


def _first_paths(g: _Share, source: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ends, rank, hops, cost, paths) of the k first paths without a repeated node, by number of hops.

    The first walks to a node are exact, and so are the simple ones among them:
    k of them are the k first paths.  Nodes with fewer get more walks, and at
    the end a search of their own.
    """
    open_ = g.wanted.copy()
    open_[source] = False
    many = k + 1
    while open_.any():
        walks = _Walks(g, source, many)
        open_ &= np.isfinite(walks.cost[:, 0])
        ends = np.flatnonzero(open_)
        ok = np.zeros((g.n, many), dtype=bool)
        turns = np.unique(walks.turn[ends])
        for t in turns[turns > 0]:
            at, slot = np.nonzero(walks.turn[ends] == t)
            for cut in range(0, len(at), HANDED):
                a, s = ends[at[cut : cut + HANDED]], slot[cut : cut + HANDED]
                ok[a, s] = _simple(walks.paths(t, walks.place[a, s]))
        # Whoever has fewer walks than asked for has them all.
        done = ends[(ok[ends].sum(axis=1) >= k) | np.isinf(walks.cost[ends, -1])]
        rank = np.cumsum(ok, axis=1)
        ok &= rank <= k
        for t in turns[turns > 0]:
            at, slot = np.nonzero((walks.turn[done] == t) & ok[done])
            step = max(1, HANDED_NODES // (t + 1))
            for cut in range(0, len(at), step):
                a, s = done[at[cut : cut + step]], slot[cut : cut + step]
                yield a, rank[a, s], np.full(len(a), t), walks.cost[a, s], walks.paths(t, walks.place[a, s])
        open_[done] = False
        if many >= MOST_WALKS:
            break
        many = min(MOST_WALKS, many * 3)
    for end in np.flatnonzero(open_):
        for i, (cost, path) in enumerate(_yen(g, source, int(end), k)):
            yield np.array([end]), np.array([i + 1]), np.array([len(path) - 1]), np.array([cost]), np.array([path])


def _one(g: _Share, prefix: list[int], start: float, end: int, barred: set[int]) -> tuple[float, int, list[int]] | None:
    """The first path by (cost, hops, nodes) that begins with a prefix, doesn't go on to barred nodes at once and repeats no node."""
    used = set(prefix[:-1])
    todo, seen = [(start, len(prefix) - 1, prefix)], set()
    while todo:
        cost, hops, path = heapq.heappop(todo)
        at = path[-1]
        if at == end:
            return cost, hops, path
        if at in seen:
            continue
        seen.add(at)
        for i in range(g.at[at], g.at[at + 1]):
            v = int(g.heads[i])
            if v not in used and v not in seen and not (len(path) == len(prefix) and v in barred):
                heapq.heappush(todo, (cost + float(g.w[i]), hops + 1, [*path, v]))
    return None


def _yen(g: _Share, source: int, end: int, k: int) -> Iterator[tuple[float, list[int]]]:
    """The k first paths without a repeated node between two nodes, by deviations."""
    step = lambda a, b: float(g.w[g.at[a] + int(np.searchsorted(g.heads[g.at[a] : g.at[a + 1]], b))])
    found: list[list[int]] = []
    todo = [x for x in [_one(g, [source], 0.0, end, set())] if x]
    while todo and len(found) < k:
        cost, _, path = heapq.heappop(todo)
        if path in found:
            continue
        found.append(path)
        yield cost, path
        start = 0.0
        for i in range(len(path) - 1):
            prefix = path[: i + 1]
            barred = {p[i + 1] for p in found if p[: i + 1] == prefix}
            if more := _one(g, prefix, start, end, barred):
                heapq.heappush(todo, more)
            start += step(path[i], path[i + 1])


def first_from(p: Projected, sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """source, target, rank, nodes, hop_count, total_cost: the k first paths by (cost, hops, nodes) without a repeated node."""

    def run(g: _Share, source: int) -> Iterator[pa.RecordBatch]:
        for ends, rank, hop, cost, paths in _first_paths(g, source, k):
            nodes = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * paths.shape[1]), pa.array(g.ids[paths].ravel()))
            yield pa.RecordBatch.from_pydict(
                {
                    "source": pa.array(np.full(len(ends), g.ids[source])),
                    "target": pa.array(g.ids[ends]),
                    "rank": pa.array(rank.astype(np.int32)),
                    "nodes": nodes,
                    "hop_count": pa.array(hop.astype(np.int32)),
                    "total_cost": pa.array(cost),
                }
            )

    return _routes(p, _dealt(p, sources, targets, None), run, nodes=True, more="rank int, ")
