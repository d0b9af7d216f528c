"""A layout of vectors in few dimensions that keeps neighbourhoods: UMAP in rounds over partitions.

The graph of near neighbours gets fuzzy weights; positions begin at principal
components; then the points are dealt into blocks, and in each round every block
takes stochastic steps for its own points against the positions that their
neighbours and a bounded sample of all points had before the round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release
from .neighbours import nearest

#: Points of a block, and points that a round repels from, at most.
BLOCK, REPELLERS = 4096, 2048


def fuzzy(near: DataFrame) -> DataFrame:
    """(id, nbr, weight): how likely an edge is, its two directions united; a, b: a + b - ab.

    Towards its neighbours a point's weights fall with the distance beyond the nearest one, at a rate at
    which they sum to log2 of their number.
    """

    def weigh(p: pd.DataFrame) -> pd.DataFrame:
        d = p["dist"].to_numpy()
        near_, target = d[d > 0].min(initial=np.inf), math.log2(max(len(d), 2))
        beyond = np.maximum(d - (near_ if np.isfinite(near_) else 0), 0)
        lo, hi = 0.0, np.inf
        sigma = 1.0
        for _ in range(64):  # bisection
            s = np.exp(-beyond / sigma).sum()
            lo, hi = (lo, sigma) if s > target else (sigma, hi)
            sigma = (lo + hi) / 2 if np.isfinite(hi) else sigma * 2
        return pd.DataFrame({"id": p["id"], "nbr": p["nbr"], "weight": np.exp(-beyond / max(sigma, 1e-3 * max(d.mean(), 1e-12)))})

    w = near.select("id", "nbr", "dist").groupBy("id").applyInPandas(weigh, "id long, nbr long, weight double")  # the k neighbours of a point
    w = materialize(w, "fuzzy")
    back = w.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), F.col("weight").alias("back"))
    both = w.join(back, ["id", "nbr"], "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    return both.select("id", "nbr", (F.col("weight") + F.col("back") - F.col("weight") * F.col("back")).alias("weight"))


def curve(spread: float, least: float) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b) nearest to the curve that is 1 up to `least` and then falls by exp(-(d - least) / spread)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < least, 1.0, np.exp(-(x - least) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):  # damped Gauss-Newton
        a, b = p
        f = 1 / (1 + a * x ** (2 * b))
        da, db = -(f**2) * x ** (2 * b), -(f**2) * a * x ** (2 * b) * 2 * np.log(x)
        j = np.stack([da, db], 1)
        p = p - np.linalg.solve(j.T @ j + 1e-3 * np.eye(2), j.T @ (f - y))
        p = np.maximum(p, 1e-3)
    return float(p[0]), float(p[1])


def steps(ids: np.ndarray, at: np.ndarray, row: np.ndarray, there: np.ndarray, weight: np.ndarray, far: np.ndarray, ab: tuple[float, float], rate: float, epochs: int, negatives: int, rng: np.random.Generator) -> np.ndarray:
    """The positions of a block's points after some epochs: pulls of their edges (row, position of the other end, weight), pushes by drawn points."""
    (a, b), x = ab, at.copy()
    inner = {int(i): k for k, i in enumerate(ids)}
    mine = np.array([inner.get(int(t), -1) for t in there[:, -1]])  # the other end is of this block: it moves as well
    for e in range(epochs):
        step = rate * (1 - e / (2 * epochs))
        on = rng.random(len(row)) < weight
        r = row[on]
        end = np.where((mine[on] >= 0)[:, None], x[mine[on]], there[on, :-1])
        d = x[r] - end
        sq = (d**2).sum(axis=1)
        pull = np.where(sq > 0, -2 * a * b * np.maximum(sq, 1e-12) ** (b - 1) / (1 + a * sq**b), 0.0)
        move = np.zeros_like(x)
        np.add.at(move, r, np.clip(pull[:, None] * d, -4, 4))
        for _ in range(negatives):
            other = far[rng.integers(0, len(far), len(r))]
            d = x[r] - other
            sq = (d**2).sum(axis=1)
            push = np.where(sq > 0, 2 * b / ((0.001 + sq) * (1 + a * sq**b)), 0.0)
            np.add.at(move, r, np.clip(push[:, None] * d, -4, 4))
        x += step * np.clip(move, -4, 4)
    return x


def _mover(far: np.ndarray, rate: float, most: float, ab: tuple[float, float], epochs: int, negatives: int, seed: tuple[int, int]):
    """The function of one round: a block's edges with the positions of both ends to its points' new positions."""

    def move(name: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["id", "nbr"], kind="stable")
        ids, first, row = np.unique(p["id"].to_numpy(), return_index=True, return_inverse=True)
        there = np.column_stack([np.stack(p["there"].to_numpy()), p["nbr"].to_numpy()])
        at = np.stack(p["at"].to_numpy())[first]
        x = steps(ids, at, row, there, p["weight"].to_numpy() / most, far, ab, rate, epochs, negatives, np.random.default_rng([*seed, int(name[0])]))
        return pd.DataFrame({"id": ids, "at": x.tolist()})

    return move


def umap(df: DataFrame, key: str, vector: str, dims: int = 2, neighbours: int = 15, least: float = 0.1, spread: float = 1.0, rounds: int = 10, epochs: int = 20, negatives: int = 5, metric: str = "cosine", seed: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, at): positions, arrays of `dims` numbers; null for rows without a vector.

    Keys are integers without repeats. With fewer than three vectors the positions are zeros. An
    empty table gives an empty result. The same table and settings give the same positions, at any partitioning.
    """
    near = nearest(df, key, vector, neighbours, metric, seed=seed)
    graph = materialize(fuzzy(near), "fuzzy-graph")
    known = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"))
    n = known.count()
    if n < 3:
        return df.select(key, F.when(F.col(vector).isNotNull(), F.array_repeat(F.lit(0.0), dims)).alias("at"))
    start = PCA(k=min(dims, len(known.first().x)), inputCol="x", outputCol="p").fit(known).transform(known).select("id", vector_to_array("p").alias("p"))
    scale = start.agg(*(F.max(F.abs(F.col("p")[i])).alias(f"m{i}") for i in range(dims))).first()
    top = max(max(scale), 1e-12)
    jitter = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(10_000)) / 10_000.0 - 0.5) * 1e-3
    at = materialize(start.select("id", F.array(*(F.col("p")[i] * (10 / top) + jitter(i) for i in range(dims))).alias("at")), "positions")
    blocks, ab = max(1, math.ceil(n / block)), curve(spread, least)
    most = graph.agg(F.max("weight")).first()[0] or 1.0
    for r in range(rounds):
        far = np.array([x.at for x in at.orderBy(F.xxhash64("id", F.lit(seed + r)), "id").limit(REPELLERS).select("at").collect()])  # a bounded sample of positions
        edges = graph.join(at, "id").join(at.select(F.col("id").alias("nbr"), F.col("at").alias("there")), "nbr")
        dealt = edges.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        before, at = at, materialize(dealt.groupBy("block").applyInPandas(_mover(far, 1 - r / rounds, most, ab, epochs, negatives, (seed, r)), "id long, at array<double>"), "positions")
        release(before)
    release(graph)
    return df.select(key, F.col(key).cast("long").alias("id__")).join(at.withColumnRenamed("id", "id__"), "id__", "left").select(key, "at")


def trustworthiness(vectors: np.ndarray, positions: np.ndarray, k: int) -> float:
    """How few strangers are among the k nearest of a layout, 1 at best; in memory, for checks on samples."""
    far = lambda x: ((x[:, None] - x[None]) ** 2).sum(axis=2)
    n = len(vectors)
    rank = far(vectors).argsort(axis=1).argsort(axis=1)
    near = far(positions) + np.diag(np.full(n, np.inf))
    seen = np.argsort(near, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * float(np.maximum(0, np.take_along_axis(rank, seen, axis=1) - k).sum())
