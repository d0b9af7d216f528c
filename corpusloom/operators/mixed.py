"""Logistic regression with a random intercept a group, by adaptive Gauss-Hermite quadrature.

The likelihood of a group is the integral over its intercept, taken at nodes
that sit where the group's own posterior lies. Rows alike are counted first;
a pass sends each batch's sums for each group and node, so no
group is gathered, and gives the gradient and the joint curvature of all
effects and of the intercepts' spread; the driver sees these sums alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release

#: An odd number: the middle node is the group's mode.
NODES = 9
#: The spread's logarithm stays above this: no variance between groups.
LEAST_LOG_SD = -7.0


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def group_terms(stats: np.ndarray, u: np.ndarray, log_sd: float, log_weight: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
    """(log likelihood, gradient, curvature, mode, the rows' own curvature there) of each group, from its sums at the nodes u (groups, nodes).

    stats: (groups, nodes, 1 + p + p * p): log likelihood, its gradient and its curvature in the effects, at each node.
    """
    var = math.exp(2 * log_sd)
    joint = stats[:, :, 0] - u**2 / (2 * var) - log_sd - 0.5 * math.log(2 * math.pi) + log_weight
    top = joint.max(axis=1, keepdims=True)
    like = np.exp(joint - top)
    total = like.sum(axis=1, keepdims=True)
    pi = like / total
    score = np.concatenate([stats[:, :, 1 : 1 + p], (u**2 / var - 1)[:, :, None]], axis=2)
    second = np.zeros((*u.shape, p + 1, p + 1))
    second[:, :, :p, :p] = stats[:, :, 1 + p :].reshape(*u.shape, p, p)
    second[:, :, p, p] = -2 * u**2 / var
    gradient = np.einsum("gq,gqi->gi", pi, score)
    curvature = np.einsum("gq,gqij->gij", pi, second + score[:, :, :, None] * score[:, :, None, :]) - gradient[:, :, None] * gradient[:, None, :]
    # a Newton step of the intercept from the middle node; the effects' first term is the intercept's as well
    middle = u.shape[1] // 2
    at, bend = u[:, middle], 1 / var - stats[:, middle, 1 + p]
    mode = at + np.clip((stats[:, middle, 1] - at / var) / bend, -2.0, 2.0)
    return (top + np.log(total))[:, 0], gradient, curvature, mode, -stats[:, middle, 1 + p]


def mixed_logit(df: DataFrame, y: str, terms: list[str], group: str, nodes: int = NODES, most: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """(term, estimate, se, z, p, odds_ratio, or_low, or_high, converged): effects, then "(sd)", the standard deviation of the intercepts.

    Standard errors come from the joint curvature of all effects and the
    logarithm of the spread (that of "(sd)" by the delta method). converged
    is false where the steps did not settle within `most` passes. Rows with a
    null in a column are left out. Without rows, or with one outcome alone, estimates are null and converged is false.
    """
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    base = np.log(w) + x * x / 2  # of an integral over u = mean + sd * x
    p = len(terms) + 1
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *(F.col(t).cast("double").alias(f"x{i}") for i, t in enumerate(terms))).dropna()
    columns = [f"x{i}" for i in range(len(terms))]
    rows = materialize(rows.groupBy("g", "y", *columns).agg(F.count(F.lit(1)).alias("n")), "mixed-rows")
    schema = "term string, estimate double, se double, z double, p double, odds_ratio double, or_low double, or_high double, converged boolean"
    names = ["(intercept)", *terms]
    scale = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y"), *(F.sum(F.col("n") * F.col(c)).alias(f"m{c}") for c in columns), *(F.sum(F.col("n") * F.col(c) * F.col(c)).alias(f"s{c}") for c in columns)).first()
    if not scale.n or scale.y in (0, scale.n):
        return df.sparkSession.createDataFrame([(t, *[None] * 7, False) for t in [*names, "(sd)"]], schema)
    mean = np.array([scale[f"m{c}"] / scale.n for c in columns])
    sd = np.sqrt(np.maximum([scale[f"s{c}"] / scale.n - m * m for c, m in zip(columns, mean, strict=True)], 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    effects, log_sd = np.zeros(p), math.log(0.7)
    effects[0] = math.log(scale.y / (scale.n - scale.y))
    groups = materialize(rows.select("g").distinct().select("g", F.lit(0.0).alias("u"), F.lit(0.0).alias("s")), "mixed-groups")
    width = 1 + p + p * p
    kind = rows.schema["g"].dataType.simpleString()

    def at_nodes(d: pd.DataFrame, log_sd: float) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each row's group, and their width: s is the curvature of the group's rows at its mode."""
        wide = 1 / np.sqrt(np.maximum(d["s"].to_numpy(), 0) + math.exp(-2 * log_sd))
        return d["u"].to_numpy()[:, None] + wide[:, None] * x, wide

    def sums(parts: Iterator[pd.DataFrame], b: np.ndarray, log_sd: float) -> Iterator[pd.DataFrame]:
        for d in parts:
            if not len(d):
                continue
            own, first = np.unique(d["g"].to_numpy(), return_inverse=True)
            z = np.column_stack([np.ones(len(d)), (d[columns].to_numpy(float).reshape(len(d), -1) - mean) / sd])
            u, _ = at_nodes(d, log_sd)
            eta, n, yy = (z @ b)[:, None] + u, d["n"].to_numpy(float)[:, None], d["y"].to_numpy()[:, None]
            q = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            out = np.zeros((len(own), nodes, width))
            np.add.at(out[:, :, 0], first, n * (yy * eta - _softplus(eta)))
            for i in range(p):
                np.add.at(out[:, :, 1 + i], first, n * (yy - q) * z[:, i : i + 1])
                for j in range(p):
                    np.add.at(out[:, :, 1 + p + i * p + j], first, -n * q * (1 - q) * z[:, i : i + 1] * z[:, j : j + 1])
            yield pd.DataFrame({"g": own, "v": out.reshape(len(own), -1).tolist()})

    def finish(parts: Iterator[pd.DataFrame], log_sd: float) -> Iterator[pd.DataFrame]:
        for d in parts:
            if not len(d):
                continue
            u, wide = at_nodes(d, log_sd)
            stats = np.stack(d["v"].to_numpy()).reshape(len(d), nodes, width)
            like, gradient, curvature, m, s = group_terms(stats, u, log_sd, base + np.log(wide)[:, None], p)
            total = np.concatenate([like[:, None], gradient, curvature.reshape(len(d), -1)], axis=1)
            yield pd.DataFrame({"g": d["g"], "u": m, "s": s, "t": total.tolist(), "moved": np.abs(m - d["u"].to_numpy())})

    best, step, settled, curvature = -np.inf, np.zeros(p + 1), False, None
    moved = np.inf
    for turn in range(most):
        near = groups.hint("shuffle_hash")  # never through the driver, round for round
        at = rows.join(near, "g").mapInPandas(lambda it, b=effects, l=log_sd: sums(it, b, l), f"g {kind}, v array<double>")
        added = at.groupBy("g").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(nodes * width))).alias("v")).join(near, "g")
        fresh = materialize(added.mapInPandas(lambda it, l=log_sd: finish(it, l), f"g {kind}, u double, s double, t array<double>, moved double"), "mixed-groups")
        *t, drift = fresh.agg(*(F.sum(F.col("t")[i]) for i in range(1 + (p + 1) + (p + 1) ** 2)), F.max("moved")).first()
        t = np.array(t)
        release(groups)
        groups = fresh.drop("t", "moved")
        groups.stored_at = fresh.stored_at
        like, gradient, now = t[0], t[1 : p + 2], t[p + 2 :].reshape(p + 1, p + 1)
        if turn > 2 and like < best - 1e-6 * abs(best):  # too far: half the way back; the nodes have settled by then
            step = step / 2
            effects, log_sd, moved = effects - step[:p], log_sd - step[p], float(np.abs(step).max())
            continue
        if turn > 2 and moved < tolerance and drift < 10 * tolerance:
            settled, curvature = True, now
            break
        best, curvature = like, now
        value, vectors = np.linalg.eigh(-now)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(value), 1e-6))
        step = np.clip(step, -1.0, 1.0)
        if log_sd + step[p] < LEAST_LOG_SD:
            step[p] = LEAST_LOG_SD - log_sd
        effects, log_sd = effects + step[:p], log_sd + step[p]
        moved = float(np.abs(step).max())
    release(groups, rows)
    inverse = np.linalg.pinv(-curvature)
    # back to the terms' own scales
    back = np.eye(p)
    back[0, 1:], back[1:, 1:] = -mean / sd, np.diag(1 / sd)
    estimate, covariance = back @ effects, back @ inverse[:p, :p] @ back.T
    out = []
    for i, name in enumerate(names):
        b, s = float(estimate[i]), float(math.sqrt(max(covariance[i, i], 0.0)))
        z = b / s if s else None
        odds = [math.exp(max(min(v, 700), -700)) for v in (b, b - 1.96 * s, b + 1.96 * s)]
        out.append((name, b, s, z, None if z is None else math.erfc(abs(z) / math.sqrt(2)), *odds, settled))
    spread = math.exp(log_sd)
    out.append(("(sd)", spread, spread * math.sqrt(max(inverse[p, p], 0.0)), None, None, None, None, None, settled))
    return df.sparkSession.createDataFrame(out, schema)
