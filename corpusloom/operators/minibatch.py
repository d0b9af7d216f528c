"""Mini-batch k-means: centres move by one batch of rows a round, each at a rate of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Rows that the first centres are drawn from.
FIRST = 4096


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and the squared distance to it."""
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    c = d.argmin(axis=1)
    return c, ((x - centres[c]) ** 2).sum(axis=1)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn by its squared distance from those before it, the best of a few draws; rows again where x has fewer texts than that."""
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        picks = rng.choice(len(x), 2 + int(np.log(k)), p=p)
        tries = [np.minimum(near, ((x - x[i]) ** 2).sum(axis=1)) for i in picks]
        best = min(range(len(tries)), key=lambda j: tries[j].sum())
        chosen.append(x[picks[best]])
        near = tries[best]
    return np.array(chosen)


@dataclass
class Clusters:
    """centres; counts: rows of the last pass that moved each; trace: mean squared distance in each round's batch before its step; moved: centres that each round placed anew."""

    centres: np.ndarray
    counts: np.ndarray
    trace: list[float]
    moved: list[int]

    def assign(self, df: DataFrame, vector: str) -> DataFrame:
        """Adds cluster and distance (squared); null where there is no vector, or one with a null or of another length."""
        centres, fields = self.centres, df.schema.fieldNames()
        if {"cluster", "distance"} & set(fields):
            raise ValueError("the table has a column cluster or distance already")

        @F.pandas_udf("struct<cluster int, distance double>")
        def run(v: pd.Series) -> pd.DataFrame:
            c, d = _nearest(np.array(v.tolist(), float), centres)
            return pd.DataFrame({"cluster": c.astype("int32"), "distance": d})

        stand_in = F.array(*map(F.lit, centres[0].tolist())) if len(centres) else F.array().cast("array<double>")
        if not len(centres):
            return df.withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double"))
        v, ok = _usable(vector, centres.shape[1])
        x = df.withColumn("to__", run(F.when(ok, v).otherwise(stand_in)))
        return x.select(*(F.col(f"`{c}`") for c in fields), F.when(ok, F.col("to__.cluster")).alias("cluster"), F.when(ok, F.col("to__.distance")).alias("distance"))


def _usable(vector: str, dims: int) -> tuple[Column, Column]:
    v = F.transform(vector, lambda x: x.cast("double"))
    return v, F.coalesce((F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def fit(df: DataFrame, key: str, vector: str, k: int, batches: int = 8, passes: int = 3, starved: float = 0.01, seed: int = 7) -> Clusters:
    """k centres of the vectors of a table.

    The rows are written once, dealt by a hash of the key into so many batches; each round reads one. A
    centre moves to the mean of all rows that have come to it in this pass, so its rate is one over their number. A centre with fewer than
    `starved` times the rows of the largest, over all passes, is placed at a row of the batch, drawn by its distance
    from the centres, but in the last pass no more, so that all settle. The first centres are drawn from at most FIRST
    rows. Sums and counts alone come to the driver, k times the width of a vector.

    Rows without key or vector, with a null within it or of another length than the
    longest are left out. Fewer distinct vectors than k give centres that are equal; an empty table has none.
    """
    dims = df.agg(F.max(F.size(vector))).first()[0] or 0
    if dims < 1:
        return Clusters(np.zeros((0, 0)), np.zeros(0), [], [])
    v, ok = _usable(vector, dims)
    kept = df.where(F.col(key).isNotNull() & ok).select(F.xxhash64(key, F.lit(seed)).alias("h"), v.alias("v"))
    rows = materialize(kept.withColumn("batch", F.pmod(F.shiftrightunsigned("h", 20), F.lit(batches)).cast("int")).repartition("batch", F.pmod("h", F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).sortWithinPartitions("batch"), "batches")
    first = np.array([r.v for r in rows.orderBy("h").limit(FIRST).collect()])
    if not len(first):
        return Clusters(np.zeros((0, 0)), np.zeros(0), [], [])
    rng = np.random.default_rng(seed)
    centres, counts, seen = _spread(first, k, rng), np.zeros(k), np.zeros(k)
    trace, moved = [], []

    def step(centres: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sums, cost = np.zeros(k), np.zeros((k, dims)), 0.0
            for p in parts:
                x = np.array(p["v"].tolist(), float).reshape(len(p), dims)
                c, d = _nearest(x, centres)
                n += np.bincount(c, minlength=k)
                np.add.at(sums, c, x)
                cost += d.sum()
            yield pd.DataFrame({"s": [np.concatenate([[cost], n, sums.ravel()])]})

        return run

    def far(centres: np.ndarray, turn: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                _, d = _nearest(np.array(p["v"].tolist(), float).reshape(len(p), dims), centres)
                u = np.array([np.random.default_rng([seed, turn, int(h) & (1 << 62) - 1]).random() for h in p["h"]])
                yield p.assign(late=-np.log(np.maximum(u, 1e-300)) / np.maximum(d, 1e-300))[d > 0].nsmallest(k, "late")

        return run

    for turn in range(batches * passes):
        batch = rows.where(F.col("batch") == turn % batches).select("h", "v")
        sums = np.zeros(1 + k + k * dims)
        for r in batch.select("v").mapInPandas(step(centres), "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[r.i] = r.x
        n = sums[1 : 1 + k]
        if not n.sum():
            continue
        trace.append(float(sums[0] / n.sum()))
        if turn % batches == 0:
            counts = np.zeros(k)  # what lay near in the pass before may lie elsewhere now
        after = counts + n
        centres = np.where(after[:, None] > 0, (centres * counts[:, None] + sums[1 + k :].reshape(k, dims)) / np.maximum(after, 1)[:, None], centres)
        counts, seen = after, seen + n
        low = np.flatnonzero(seen < starved * seen.max())
        moved.append(0)
        if len(low) and turn < batches * (passes - 1):
            drawn = batch.mapInPandas(far(centres, turn), "h long, v array<double>, late double").orderBy("late", "h").limit(len(low)).collect()  # at most k
            for i, r in zip(low, drawn, strict=False):
                centres[i] = r.v
            moved[-1] = len(drawn)
            seen[low[: len(drawn)]] = seen[np.setdiff1d(np.arange(k), low)].min()
            counts[low[: len(drawn)]] = 0
    release(rows)
    return Clusters(centres, counts, trace, moved)
