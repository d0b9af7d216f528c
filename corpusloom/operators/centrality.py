"""Betweenness of graphs of any size: breadth-first rounds of joins over batches of sources, nodes that are alike as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release

#: Classes of sources that are followed at once; a batch's tables have at most so many rows a class.
BATCH = 512


def _twins(arcs: DataFrame) -> DataFrame:
    """(node, c, m): nodes by what they point at and what points at them; c is the least node of those alike, m their number."""
    print_ = lambda end, x: [F.bit_xor(F.xxhash64(end, F.lit(i))).alias(f"{x}{i}") for i in (1, 2)] + [F.count(F.lit(1)).alias(f"{x}n")]
    out = arcs.groupBy(F.col("a").alias("node")).agg(*print_("b", "o"))
    both = out.join(arcs.groupBy(F.col("b").alias("node")).agg(*print_("a", "i")), "node", "full").na.fill(0)
    alike = ["o1", "o2", "on", "i1", "i2", "in"]
    return both.join(both.groupBy(*alike).agg(F.min("node").alias("c"), F.count(F.lit(1)).alias("m")), alike).select("node", "c", "m")


def betweenness(edge: DataFrame, src: str = "subject", dst: str = "object", batch: int = BATCH) -> DataFrame:
    """(node, betweenness): directed, unweighted, not normalised, exact; parallel edges count once, loops not at all.

    Nodes that point at the same nodes and are pointed at by the same (told by 128 bits of hash and their numbers)
    have the same betweenness, so that each such class is one node that counts several times. For each
    batch of source classes the frontier goes out from one member a step a round and sums
    the shortest paths to a member of each class; then the dependencies come
    back, a step a round, along the same edges. The source's own twins lie beyond it, and no
    shortest path from it goes through them. All state is in tables. Edges with a null end are left out; an
    empty graph gives an empty result. The work is that of the graph of classes: its sources times its edges.
    """
    arcs = materialize(edge.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "arcs")
    nodes = arcs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    arcs = arcs.where("a <> b")
    twins = materialize(_twins(arcs), "twins")
    end = lambda x: twins.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.col("m").alias(f"m{x}"))
    arcs = materialize(arcs.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("ma").alias("copies"), F.col("cb").alias("b"), F.col("mb").alias("m")).distinct(), "class-arcs")
    sources = arcs.select(F.col("a").alias("source"), "copies").distinct()  # others reach nothing
    steps = arcs.select(F.col("a").alias("node"), "b", "m")
    batches = max(1, -(-sources.count() // batch))
    totals = None
    for i in range(batches):
        mine = sources.where(F.pmod(F.xxhash64("source"), F.lit(batches)) == i)
        # paths: to one member; many: members, the source itself left out
        levels = [materialize(mine.select("source", "copies", F.col("source").alias("node"), F.lit(1.0).alias("paths"), F.lit(1).cast("long").alias("many")), "frontier")]
        seen = None
        while True:
            step = levels[-1].join(steps, "node").groupBy("source", "copies", "b", "m").agg(F.sum(F.col("paths") * F.col("many")).alias("paths"))
            step = step.select("source", "copies", F.col("b").alias("node"), "paths", (F.col("m") - (F.col("b") == F.col("source")).cast("long")).alias("many")).where("many > 0")
            fresh = materialize(step if seen is None else step.join(seen, ["source", "node"], "left_anti"), "frontier")
            if not fresh.limit(1).count():
                release(fresh)
                break
            levels.append(fresh)
            seen = fresh.select("source", "node") if seen is None else seen.unionByName(fresh.select("source", "node"))
        flow = None  # (source, copies, node, paths, many, flow) of the level beyond
        for k in range(len(levels) - 1, 0, -1):
            here = levels[k]
            if flow is not None:
                back = steps.join(flow.select("source", F.col("node").alias("b"), (F.col("many") * (1 + F.col("flow")) / F.col("paths")).alias("share")), "b")
                got = back.groupBy("source", "node").agg(F.sum("share").alias("share"))
                here = here.join(got, ["source", "node"], "left").withColumn("flow", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share")
            else:
                here = here.withColumn("flow", F.lit(0.0))
            flow = materialize(here, "flow")
            part = flow.where("flow > 0").groupBy("node").agg(F.sum(F.col("flow") * F.col("copies")).alias("flow"))
            totals = part if totals is None else totals.unionByName(part)
        totals = None if totals is None else materialize(totals.groupBy("node").agg(F.sum("flow").alias("flow")), "betweenness")
        release(*levels)
    if totals is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    of = twins.join(totals.withColumnRenamed("node", "c"), "c").select("node", "flow")
    return nodes.join(of, "node", "left").select("node", F.coalesce("flow", F.lit(0.0)).alias("betweenness"))
