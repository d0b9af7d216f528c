"""Leiden communities of a weighted undirected graph, in rounds over tables.

A level has three phases. Nodes move to the neighbouring community of most
gain in modularity; each community is refined, from single nodes, by random
merges of what is well connected inside it; the refined parts become the
nodes of the next level, which begins with the communities that they lie in.

Every phase is a loop of joins over adjacency and labels, a table a round, so no
task or driver holds the graph. Moves of one round may spoil each
other: a round takes the wishes of a share of the nodes. Where modularity did
not rise it is taken back and a smaller share is tried; with each rise the share
grows again. Where a share is a few wishes alone, moves are made that touch no
community that another move of more gain touches; the gains of these add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release
from .sampling import ranked

#: A round that raises modularity by less ends its phase.
LEAST_GAIN = 1e-6
EPS = 1e-9
#: The largest share of the nodes that may move in one round, what it is divided by where they spoil each other and multiplied by where they don't, and how few wishes are met apart.
SHARE, LESS, MORE, FEW = 0.5, 4.0, 1.5, 2


def _uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number in (0, 1) by hash, the same on any machine."""
    h = F.pmod(F.xxhash64(F.lit(seed), *(F.lit(p) if isinstance(p, int) else p for p in parts)), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def _wishes(adjacency: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """(node, k, own, c, inside, gain, to): each node's best move and what it would gain; inside is its weight to its own community."""
    strength = labels.groupBy("c").agg(F.sum("k").alias("whole"))
    held = labels.join(strength, "c")
    there = held.select(F.col("node").alias("b"), F.col("c").alias("to"), F.col("whole").alias("strength"))
    to = adjacency.join(there, "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"), F.first("strength").alias("strength"))
    other = F.col("to") != F.col("c")
    pull = F.round(F.col("w") - resolution * F.col("k") * F.col("strength") / total, 9)
    best = (F.sum(F.when(other, 0.0).otherwise(F.col("w"))).alias("inside"), F.max(F.when(other, F.struct(pull.alias("pull"), "to"))).alias("best"))
    out = to.join(held, "node", "right").groupBy("node", "k", "own", "c", "whole").agg(*best)
    inside = F.coalesce("inside", F.lit(0.0))
    gain = F.col("best.pull") - (inside - resolution * F.col("k") * (F.col("whole") - F.col("k")) / total)
    return out.select("node", "k", "own", "c", inside.alias("inside"), (2 * gain / total).alias("gain"), F.col("best.to").alias("to"))


def _quality(wishes: DataFrame, total: float, resolution: float) -> tuple[float, int]:
    """(modularity of the labels, number of nodes that would gain by a move)."""
    by = wishes.groupBy("c").agg(F.sum("k").alias("k"), F.sum(F.col("inside") + F.col("own")).alias("inside"), F.count_if(F.col("gain") > EPS).alias("n"))
    r = by.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("n").alias("n")).first()
    return r.inside / total - resolution * r.squares / total**2, r.n


def _apart(wishes: DataFrame) -> DataFrame:
    """The labels after the moves that are the best of all that touch their old and their new community."""
    moves = wishes.where(F.col("gain") > EPS).select("node", "c", "to", F.struct("gain", F.xxhash64("node").alias("h"), "node").alias("rank"))
    first = moves.select(F.explode(F.array("c", "to")).alias("touched"), "rank").groupBy("touched").agg(F.max("rank").alias("first"))
    won = moves.join(first, moves["rank"] == first["first"]).groupBy(moves["node"], moves["to"]).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    new = won.select(won["node"].alias("moved"), won["to"].alias("there"))
    return wishes.join(new, wishes["node"] == new["moved"], "left").select("node", "k", "own", F.coalesce("there", "c").alias("c"))


def _move(adjacency: DataFrame, labels: DataFrame, total: float, resolution: float, seed: int, least: float) -> tuple[DataFrame, float]:
    """(wishes at the labels that no round raises further, their modularity)."""
    best, quality, round_, share, n = None, 0.0, 0, SHARE, 0
    apart = False  # whether the labels at hand came of moves apart
    while True:
        wishes = materialize(_wishes(adjacency, labels, total, resolution), "wishes")
        now, wish = _quality(wishes, total, resolution)
        if best is None or now > quality + least:
            if best is not None:
                release(best)
                share = share if apart else min(SHARE, share * MORE)
            best, quality, n = wishes, now, wish
        else:
            release(wishes)
            if apart:
                return best, quality
            share /= LESS
        if not n:
            return best, quality
        apart = n * share <= FEW
        some = _uniform(seed, round_, "node") < share
        together = best.select("node", "k", "own", F.when((F.col("gain") > EPS) & some, F.col("to")).otherwise(F.col("c")).alias("c"))
        labels = _apart(best) if apart else together
        round_ += 1


def _refine(adjacency: DataFrame, placed: DataFrame, total: float, resolution: float, theta: float, seed: int) -> DataFrame:
    """(node, k, own, c, part): each community cut into connected parts, grown from single nodes by random merges."""
    whole = placed.groupBy("c").agg(F.sum("k").alias("whole"))
    state = materialize(placed.join(whole, "c").select("node", "k", "own", "c", "inside", "whole", F.col("node").alias("part")), "parts")
    inner = adjacency.join(state.select(F.col("node").alias("a"), "c"), "a").join(state.select(F.col("node").alias("b"), F.col("c").alias("c2")), "b")
    inner = materialize(inner.where("c = c2").select("a", "b", "w"), "inner")
    round_ = 0
    while True:
        to = inner.join(state.select(F.col("node").alias("b"), F.col("part").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
        at = state.join(to, "node", "left")
        held = at.groupBy("part").agg(F.sum(F.when(F.col("to") == F.col("part"), F.col("w"))).alias("own_w"))
        parts = state.groupBy("part").agg(F.sum("k").alias("pk"), F.count(F.lit(1)).alias("n"), F.sum("inside").alias("reach"), F.first("whole").alias("pw")).join(held, "part", "left")
        tied = F.col("reach") - F.coalesce("own_w", F.lit(0.0)) >= resolution * F.col("pk") * (F.col("pw") - F.col("pk")) / total - EPS
        parts = materialize(parts.select("part", "pk", "n", tied.alias("tied")), "part-sizes")
        single = parts.where("n = 1 and tied").select("part")
        gain = F.round(F.col("w") - resolution * F.col("k") * F.col("pk") / total, 9)
        wish = at.where("to is not null and to <> part").join(single, "part", "left_semi").join(parts.select(F.col("part").alias("to"), "pk", "n", "tied"), "to")
        wish = wish.where(F.col("tied") & (gain >= 0))
        drawn = gain / (theta * F.col("k")) - F.ln(-F.ln(_uniform(seed, round_, "node", "to")))  # of gumbel noise: with probability in proportion to exp(gain / theta k)
        wish = wish.groupBy("node").agg(F.max(F.struct(drawn.alias("drawn"), "to", "n")).alias("m"))
        wish = materialize(wish.select("node", F.col("m.to").alias("to"), F.col("m.n").alias("n"), _uniform(seed + 1, round_, "node").alias("h")), "merges")
        if wish.isEmpty():
            release(inner, parts, wish)
            return state
        # a single node that is wished for by a node of higher hash stays and receives; the others move to parts that stay
        asked = wish.where("n = 1").groupBy(F.col("to").alias("asked")).agg(F.max("h").alias("most"))
        stays = asked.join(wish.select(F.col("node").alias("asked"), "h"), "asked", "left").where("h is null or h < most").select("asked")
        moves = wish.join(stays, wish["node"] == stays["asked"], "left_anti")
        moves = moves.where("n > 1").unionByName(moves.where("n = 1").join(stays, F.col("to") == F.col("asked"), "left_semi")).select("node", "to")
        before, state = state, materialize(state.join(moves, "node", "left").select("node", "k", "own", "c", "inside", "whole", F.coalesce("to", "part").alias("part")), "parts")
        release(before, parts, wish)
        round_ += 1


def _connected(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, c, piece): the smallest node that a node reaches inside its community."""
    l = labels.select("node", "c")
    inner = adjacency.join(l.select(F.col("node").alias("a"), "c"), "a").join(l.select(F.col("node").alias("b"), F.col("c").alias("c2")), "b").where("c = c2")
    inner = materialize(inner.select("a", "b"), "inner")
    state = materialize(l.withColumn("piece", F.col("node")), "pieces")
    while True:
        near = inner.join(state.select(F.col("node").alias("b"), "piece"), "b").groupBy("a").agg(F.min("piece").alias("near"))
        step = state.join(near, F.col("node") == F.col("a"), "left").select("node", "c", "piece", F.least("piece", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))  # and on to where that node stands
        after = materialize(step.join(jump, "new").select("node", "c", F.least("new", "far").alias("piece"), (F.least("new", "far") != F.col("piece")).alias("changed")), "pieces")
        release(state)
        if not after.where("changed").limit(1).count():
            release(inner)
            return after.select("node", "c", "piece")
        state = after.drop("changed")
        state.stored_at = after.stored_at


def leiden(graph: DataFrame, resolution: float = 1.0, theta: float = 0.1, seed: int = 1, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(node, community) of an undirected graph (a, b, weight), communities numbered from 1 by size and smallest node.

    Repeated pairs add up, a pair of a node with itself is a loop, pairs
    without a weight above 0 or with a null end are left out, and an empty
    graph has no communities. The same graph and seed give the same result at
    any partitioning, up to sums that are equal to nine digits. Communities are connected.
    """
    g = graph.where("a is not null and b is not null and weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = g.where("a <> b").unionByName(g.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    adjacency = first = materialize(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "adjacency")
    loops = g.where("a = b").groupBy(F.col("a").alias("node")).agg((2 * F.sum("w")).alias("own"))
    nodes = adjacency.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(loops, "node", "full").select("node", F.coalesce("own", F.lit(0.0)).alias("own"), (F.coalesce("k", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("k"))
    labels = materialize(nodes.select("node", "k", "own", F.col("node").alias("c")), "labels")
    total = labels.agg(F.sum("k")).first()[0]
    if not total:
        return labels.select("node", F.lit(0).cast("long").alias("community"))
    at = materialize(labels.select("node", F.col("node").alias("holder")), "holders")  # which node of the level a node is in
    level, count = 0, labels.count()
    while True:
        wishes, _ = _move(adjacency, labels, total, resolution, seed + level, least_gain)
        parts = _refine(adjacency, wishes, total, resolution, theta, seed + level)
        fresh = parts.select("part").distinct().count()
        place = parts.select(F.col("node").alias("holder"), "part", "c")
        here = materialize(at.select("node", "holder").join(place, "holder").select("node", F.col("part").alias("holder"), "c"), "holders")
        release(at, wishes)
        at = here
        if fresh == count:
            break
        named = parts.select("node", "part")
        between = adjacency.join(named.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(named.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
        sums = materialize(between.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w")), "adjacency")
        inside = sums.where("a = b").select(F.col("a").alias("part"), F.col("w").alias("more"))
        merged = parts.groupBy("part").agg(F.sum("k").alias("k"), F.sum("own").alias("own"), F.first("c").alias("c")).join(inside, "part", "left")
        labels = materialize(merged.select(F.col("part").alias("node"), "k", (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("own"), "c"), "labels")
        adjacency, count, level = sums.where("a <> b"), fresh, level + 1
        release(parts)
    pieces = _connected(first, at)
    sizes = pieces.groupBy("piece").agg((-F.count(F.lit(1))).alias("less")).withColumn("all", F.lit(0))
    numbered = ranked(sizes, "all", "less", "piece", name="community")
    return pieces.join(numbered.select("piece", F.col("community").cast("long").alias("community")), "piece").select("node", "community")
