"""Density clusters with noise: HDBSCAN on a graph of near neighbours.

Mutual reachability weighs the edges of the neighbour graph; Boruvka rounds
find its minimum spanning forest; its edges, lightest first, build the
condensed tree: parts of at least `least` points are clusters, smaller parts
that fall off leave a cluster at that distance. Edges come in chunks of a
bounded number, and a chunk is all that one task sees: between chunks the
parts stand as one name for each point, a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release
from .neighbours import nearest
from .sampling import ranked

#: Edges of the spanning forest that one task works off at a time.
CHUNK = 1 << 20


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """(u, v, w) with u < v: the neighbours' distances, or the core distance of an end where that is more.

    The core distance is that of the samples-th neighbour, the point itself counted as the first.
    """
    core = near.where(F.col("rank") <= max(1, samples - 1)).groupBy("id").agg(F.max("dist").alias("core"))
    pairs = near.select(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v"), "dist").groupBy("u", "v").agg(F.min("dist").alias("dist"))
    pairs = pairs.join(core.select(F.col("id").alias("u"), F.col("core").alias("cu")), "u").join(core.select(F.col("id").alias("v"), F.col("core").alias("cv")), "v")
    return pairs.select("u", "v", F.greatest("dist", "cu", "cv").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w): the minimum spanning forest of a graph, ties by the names of the ends; in Boruvka rounds."""
    live = materialize(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest-edges")
    found = []
    while live.limit(1).count():
        ends = live.select(F.col("cu").alias("c"), F.col("cv").alias("to"), "w", "u", "v").unionByName(live.select(F.col("cv").alias("c"), F.col("cu").alias("to"), "w", "u", "v"))
        least = materialize(ends.groupBy("c").agg(F.min(F.struct("w", "u", "v", "to")).alias("m")).select("c", "m.*"), "lightest")
        found.append(least)
        # each part points along its lightest edge; of two that point at each other the smaller is the root
        mutual = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = materialize(least.join(mutual, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")), "roots")
        while True:
            jump = root.select(F.col("c").alias("root"), F.col("root").alias("far"))
            after = materialize(root.join(jump, "root").select("c", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
            release(root)
            done = not after.where("moved").limit(1).count()
            root = after.drop("moved")
            root.stored_at = after.stored_at
            if done:
                break
        # an end whose part has no edge left never comes up again
        named = live.join(root.select(F.col("c").alias("cu"), F.col("root").alias("ru")), "cu").join(root.select(F.col("c").alias("cv"), F.col("root").alias("rv")), "cv")
        lightest = named.where("ru <> rv").groupBy(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("m"))
        before, live = live, materialize(lightest.select("m.u", "m.v", "m.w", "cu", "cv"), "forest-edges")
        release(before, root)
    out = edges.select("u", "v", "w").limit(0)
    for f in found:
        out = out.unionByName(f.select("u", "v", "w"))
    return out.distinct()


class Parts:
    """The parts of a chunk: their sizes, the clusters that they are, and what they were made of."""

    def __init__(self, least: int) -> None:
        self.least, self.up, self.size, self.cluster, self.made = least, {}, {}, {}, {}

    def add(self, part: int, size: int, cluster: int | None) -> None:
        if part not in self.up:
            self.up[part], self.size[part], self.cluster[part], self.made[part] = part, size, cluster, [part]

    def root(self, part: int) -> int:
        while self.up[part] != part:
            self.up[part] = self.up[self.up[part]]
            part = self.up[part]
        return part

    def join(self, a: int, b: int, w: float, name: int) -> Iterator[tuple]:
        """What happens as two parts meet: ("point", part, cluster, w), or ("child", cluster, parent, w)."""
        a, b = self.root(a), self.root(b)
        if self.size[a] < self.size[b]:
            a, b = b, a
        ca, cb = self.cluster[a], self.cluster[b]
        total, cluster = self.size[a] + self.size[b], ca if cb is None else cb
        if ca is not None and cb is not None:  # two clusters: both begin here
            yield from (("child", c, name, w) for c in (ca, cb))
            cluster = name
        elif ca is None and cb is None and total >= self.least:  # a cluster in which no denser one lies
            yield from (("point", x, name, w) for x in (*self.made[a], *self.made[b]))
            cluster = name
        elif ca is not None or cb is not None:  # a small part leaves here
            yield from (("point", x, cluster, w) for x in self.made[b if cb is None else a])
        # a cluster's parts need no names any more: their points have left
        made = self.made.pop(b)
        if cluster is None:
            self.made[a].extend(made)
        else:
            self.made[a] = []
        self.up[b], self.size[a], self.cluster[a] = a, total, cluster


def condensed(forest: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(points: id, cluster, w; tree: cluster, parent, w): where each point leaves which cluster, and where clusters part.

    Clusters are named by the place of the edge that closes them, lightest first. Points in no cluster have no row.
    """
    spark = forest.sparkSession
    edges = materialize(ranked(forest.withColumn("all", F.lit(0)), "all", "w", "u", "v", name="place").select("place", "u", "v", "w"), "forest")
    n = edges.count()
    labels = materialize(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("part"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster")), "part-labels")
    events = []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = Parts(least), []
        for p in parts:
            for place, w, a, sa, ca, b, sb, cb in p.itertuples(index=False, name=None):
                state.add(a, sa, None if pd.isna(ca) else int(ca))
                state.add(b, sb, None if pd.isna(cb) else int(cb))
                out.extend(state.join(a, b, w, place))
        for x in state.up:
            r = state.root(x)
            out.append(("part", x, r, float(state.size[r])))
            if x == r and state.cluster[r] is not None:
                out.append(("cluster", r, state.cluster[r], 0.0))
        yield pd.DataFrame(out, columns=["kind", "a", "b", "w"])

    for lo in range(0, n, chunk):
        some = edges.where((F.col("place") > lo) & (F.col("place") <= lo + chunk))
        end = lambda x: labels.select(F.col("id").alias(x), F.col("part").alias(f"p{x}"), F.col("size").alias(f"s{x}"), F.col("cluster").alias(f"c{x}"))  # noqa: B023, E731
        met = some.join(end("u"), "u").join(end("v"), "v").select("place", "w", "pu", "su", "cu", "pv", "sv", "cv")
        ordered = met.repartition(1).sortWithinPartitions("place")  # `chunk` rows at most
        made = materialize(ordered.mapInPandas(run, "kind string, a long, b long, w double"), "condensed")
        left = made.where("kind = 'point'").select(F.col("a").alias("part"), F.col("b").alias("to"), "w").join(labels, "part")
        events.append((materialize(left.select("id", F.col("to").alias("cluster"), "w"), "left-points"), materialize(made.where("kind = 'child'").select(F.col("a").alias("cluster"), F.col("b").alias("parent"), "w"), "children")))
        if lo + chunk < n:
            now = made.where("kind = 'part'").select(F.col("a").alias("part"), F.col("b").alias("new"), F.col("w").cast("long").alias("new_size"))
            of = made.where("kind = 'cluster'").select(F.col("a").alias("new"), F.col("b").alias("new_cluster"))
            moved = labels.join(now, "part", "left").withColumn("part", F.coalesce("new", "part")).drop("new")
            moved = moved.join(of.withColumnRenamed("new", "part"), "part", "left")
            before, labels = labels, materialize(moved.select("id", "part", F.coalesce("new_size", "size").alias("size"), F.coalesce("new_cluster", "cluster").alias("cluster")), "part-labels")
            release(before)
        release(made)
    release(labels, edges)
    if not events:
        empty = spark.createDataFrame([], "id long, cluster long, w double"), spark.createDataFrame([], "cluster long, parent long, w double")
        return empty
    points, tree = events[0]
    for p, t in events[1:]:
        points, tree = points.unionByName(p), tree.unionByName(t)
    return points, tree


def stabilities(points: DataFrame, tree: DataFrame) -> DataFrame:
    """(cluster, parent, n, stability, leaf): over a cluster's points, how much denser than at its birth they are where they leave it."""
    depth = lambda w: 1 / F.greatest(w, F.lit(1e-12))
    own = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("own"), F.sum(depth(F.col("w"))).alias("left"), F.max(depth(F.col("w"))).alias("top"))
    up = tree.groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("children"), F.max(depth(F.col("w"))).alias("split"))
    names = points.select("cluster").unionByName(tree.select("cluster")).unionByName(tree.select(F.col("parent").alias("cluster"))).distinct()
    nodes = names.join(own, "cluster", "left").join(up, "cluster", "left").join(tree.withColumnRenamed("w", "birth"), "cluster", "left")
    nodes = materialize(nodes.select("cluster", "parent", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("split", F.lit(0.0)).alias("split"), F.coalesce(depth(F.col("birth")), F.lit(0.0)).alias("born"), F.col("children").isNull().alias("leaf")), "clusters")
    # sizes of whole subtrees, upwards: each cluster's points are sent to all above it, a level a round
    total, at = nodes.select("cluster", F.col("own").alias("n")), nodes.where("parent is not null").select(F.col("parent").alias("to"), "own")
    while at.limit(1).count():
        total = materialize(total.unionByName(at.select(F.col("to").alias("cluster"), F.col("own").alias("n"))).groupBy("cluster").agg(F.sum("n").alias("n")), "subtrees")
        at = materialize(at.join(nodes.select(F.col("cluster").alias("to"), "parent"), "to").where("parent is not null").groupBy(F.col("parent").alias("to")).agg(F.sum("own").alias("own")), "upwards")
    all_ = nodes.join(total, "cluster")
    stability = F.col("left") - F.col("own") * F.col("born") + (F.col("n") - F.col("own")) * (F.col("split") - F.col("born"))
    return all_.select("cluster", "parent", "n", stability.alias("stability"), "leaf")


def chosen(clusters: DataFrame, method: str) -> DataFrame:
    """(cluster, chosen): for each cluster in or under a chosen one, which; leaf: those without children, eom: those of most stability."""
    if method == "leaf":
        return clusters.where("leaf").select("cluster", F.col("cluster").alias("chosen"))
    if method != "eom":
        raise ValueError(f"no choice of clusters by the name {method}")
    # upwards: a cluster whose children are all settled compares itself with them; a root is no choice unless it is alone
    settled = materialize(clusters.where("leaf").select("cluster", "parent", F.col("stability").alias("value"), F.lit(True).alias("own")), "settled")
    while True:
        sums = settled.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("below"), F.count(F.lit(1)).alias("n")).where("n = 2")
        more = clusters.where("not leaf").join(sums, "cluster").join(settled.select("cluster"), "cluster", "left_anti")
        keeps = (F.col("stability") >= F.col("below")) & F.col("parent").isNotNull()
        more = materialize(more.select("cluster", "parent", F.when(keeps, F.col("stability")).otherwise(F.col("below")).alias("value"), keeps.alias("own")), "settled")
        if not more.limit(1).count():
            break
        settled = materialize(settled.unionByName(more), "settled")
    # downwards: the uppermost that keeps itself takes what lies under it
    at = settled.where("parent is null").select("cluster", F.when(F.col("own"), F.col("cluster")).alias("chosen"))
    out = at
    while True:
        below = settled.where("parent is not null").join(at.select(F.col("cluster").alias("parent"), "chosen"), "parent")
        at = materialize(below.select("cluster", F.coalesce("chosen", F.when(F.col("own"), F.col("cluster"))).alias("chosen")), "chosen")
        if not at.limit(1).count():
            return out.where("chosen is not null")
        out = out.unionByName(at)


def clusters(df: DataFrame, key: str, vector: str, least: int, samples: int | None = None, method: str = "leaf", neighbours: int | None = None, metric: str = "euclidean", chunk: int = CHUNK) -> DataFrame:
    """(key, cluster): density clusters numbered from 0, largest first (ties by name), and -1 for noise.

    least: points of a cluster at least; samples: neighbours of a core
    distance, `least` by default. The graph has `neighbours` neighbours a point
    (samples by default); parts of it that no edge joins are clusters apart, as if joined at an infinite distance. Keys are
    integers without repeats; rows without a key or a vector get -1. An empty table gives an empty result.
    """
    samples = samples or least
    near = nearest(df, key, vector, max(neighbours or samples, samples - 1, 1), metric)
    forest = spanning_forest(reachability(near, samples))
    points, tree = condensed(forest, least, chunk)
    pick = chosen(stabilities(points, tree), method)
    placed = materialize(points.join(pick, "cluster").select("id", "chosen"), "placed")
    sizes = placed.groupBy("chosen").agg((-F.count(F.lit(1))).alias("less")).withColumn("all", F.lit(0))
    numbered = ranked(sizes, "all", "less", "chosen", name="place").select("chosen", (F.col("place") - 1).cast("long").alias("cluster"))
    named = placed.join(numbered, "chosen").select(F.col("id").alias("id__"), F.col("cluster").alias("cluster__"))
    return df.select(key).join(named, F.col(key) == F.col("id__"), "left").select(key, F.coalesce("cluster__", F.lit(-1).cast("long")).alias("cluster"))
