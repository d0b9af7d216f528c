"""Nearest neighbours of vectors, approximately: a forest of random projections, then rounds of neighbour descent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release

#: Vectors that meet all at once: a leaf of a tree. Larger leaves (of copies, say) are cut by a hash.
LEAF = 256
TREES = 6


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(id, nbr, dist, rank): the k nearest of each id, ties by nbr."""
    near = pairs.groupBy("id", "nbr").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, nbr, dist): the k nearest of each among these, by Euclidean distance, themselves left out."""
    sq = (x * x).sum(axis=1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    d[ids[:, None] == ids[None, :]] = np.inf
    take = min(k, len(ids) - 1)
    near = np.argpartition(d, take - 1, axis=1)[:, :take] if take else np.zeros((len(ids), 0), int)
    row = np.repeat(np.arange(len(ids)), near.shape[1])
    dist = np.sqrt(((x[row] - x[near.ravel()]) ** 2).sum(axis=1))  # without the cancellation above
    ok = np.isfinite(d[row, near.ravel()])
    return ids[row][ok], ids[near.ravel()][ok], dist[ok]


def _meet_sorted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, nbr, dist) of rows (g, id, v) sorted by g: those of one g meet; a group that goes on in the next batch is carried over."""

    def out(g: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        met = [_meet(ids[lo:hi], x[lo:hi], k) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[i] for m in met])) for i in range(3)], ["id", "nbr", "dist"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1))
        if held is not None:
            now = tuple(np.concatenate(pair) for pair in zip(held, now, strict=True))
        at = int(np.searchsorted(now[0], now[0][-1]))  # where the last group begins
        if at:
            yield out(*(c[:at] for c in now))
        held = tuple(c[at:] for c in now)
    if held is not None:
        yield out(*held)


def _met(rows: DataFrame, k: int) -> DataFrame:
    """(id, nbr, dist): the k nearest of each row (g, id, v) within its group g; a task works off many groups."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but work: not to be merged into few tasks
    dealt = rows.select("g", "id", "v").repartition(parts, "g").sortWithinPartitions("g", "id")
    return dealt.mapInArrow(lambda batches: _meet_sorted(batches, k), "id long, nbr long, dist double")


def nearest(df: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", trees: int = TREES, rounds: int = 2, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """(id, nbr, dist, rank): k neighbours of each vector, nearest first; keys are integers without repeats.

    metric: euclidean, or cosine (the distance between vectors of length one).
    Rows without key or vector are left out; fewer rows than k give fewer neighbours.

    Each tree cuts the space by the signs of random projections about their mean, so deep that
    a leaf has about `leaf` vectors, which meet all at once. Then, in each
    round, the neighbours of a vector and some that it is a neighbour of meet
    each other. A task works off its leaves or neighbourhoods one by one.
    """
    spark = df.sparkSession
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no metric of the name {metric}")
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("norm", norm).select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))
    rows = materialize(rows, "vectors")
    first = rows.first()
    if first is None:
        return rows.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    n, dims = rows.count(), len(first.v)
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    planes = np.random.default_rng(seed).normal(size=(dims, trees * depth)) if depth else np.zeros((dims, 0))

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(planes.shape[1])
        for p in parts:
            total += (np.stack(p["v"].to_numpy()) @ planes).sum(axis=0) if len(p) else 0
        yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    means = np.zeros(planes.shape[1])
    if depth:
        for r in rows.select("v").mapInPandas(project, "i int, s double").groupBy("i").agg((F.sum("s") / n).alias("m")).collect():  # a number a projection
            means[r.i] = r.m

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            side = (np.stack(p["v"].to_numpy()) @ planes > means).reshape(len(p), trees, depth)
            codes = side @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros((len(p), trees), np.int64)
            for t in range(trees if depth else 1):
                yield pd.DataFrame({"id": p["id"], "v": p["v"], "tree": np.int32(t), "leaf": codes[:, t]})

    coded = rows.mapInPandas(code, "id long, v array<double>, tree int, leaf long")
    sizes = rows.mapInPandas(code, "id long, v array<double>, tree int, leaf long").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    cut = coded.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / leaf)))
    best = materialize(_top(_met(cut.withColumn("g", F.xxhash64("tree", "leaf", "part")), k), k), "neighbours")
    for r in range(rounds if n > leaf else 0):
        back = Window.partitionBy("nbr").orderBy(F.xxhash64("id", F.lit(r)))
        some = best.withColumn("r", F.row_number().over(back)).where(F.col("r") <= k)
        at = best.select(F.col("id").alias("middle"), F.col("nbr").alias("id")).unionByName(some.select(F.col("nbr").alias("middle"), "id")).unionByName(rows.select(F.col("id").alias("middle"), "id")).distinct()
        found = _met(at.join(rows, "id").withColumnRenamed("middle", "g"), k)
        before, best = best, materialize(_top(best.select("id", "nbr", "dist").unionByName(found), k), "neighbours")
        release(before)
    release(rows)
    return best
