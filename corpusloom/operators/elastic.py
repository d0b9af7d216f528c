"""Elastic-net paths of logistic models, of two classes or more, for all penalties and folds at once.

The penalised likelihood is climbed by bounds: the curvature of the loss never exceeds a
multiple of the Gram matrix, which is summed once, a matrix a fold; an iteration is one
pass over the rows that sums the gradients of every penalty and fold at their present
coefficients; then coordinate descent minimises each bound. Coefficients begin at zero, where the
path begins, and each penalty goes on from where it stands until it has settled. The driver sees sums of a size given by features, penalties and folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..session import release_in_loop as release
from .learn import folds

PENALTIES, SMALLEST = 100, 0.01
#: A path ends where no coefficient moves by more in an iteration, or after so many passes.
TOLERANCE, PASSES = 1e-4, 60
#: A penalty that has settled in so many iterations in a row is left where it stands, and costs later passes nothing.
CALM = 2


@dataclass
class Path:
    """coefficients: (penalty, class, 1 + features), intercepts first, on the features' own scales."""

    classes: list
    penalties: np.ndarray
    coefficients: np.ndarray
    deviance: np.ndarray  # mean held-out deviance a row, by penalty
    error: np.ndarray  # its standard error over folds
    best: int
    chosen: int
    passes: int
    converged: bool

    def probabilities(self, features: Column, at: int | None = None) -> Column:
        """An array of the classes' probabilities, at the chosen penalty."""
        w = self.coefficients[self.chosen if at is None else at]
        eta = [F.aggregate(F.zip_with(features, F.array(*(F.lit(float(v)) for v in c[1:])), lambda x, y: x * y), F.lit(float(c[0])), lambda a, x: a + x) for c in w]
        top = F.greatest(*eta) if len(eta) > 1 else eta[0]
        e = [F.exp(x - top) for x in eta]
        total = e[0]
        for x in e[1:]:
            total = total + x
        return F.array(*(x / total for x in e))


def _descend(gram: np.ndarray, linear: np.ndarray, w: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 30, eps: float = 1e-7) -> np.ndarray:
    """Minimises w'Gw/2 - linear'w + l1 |w| + l2 w'w/2 for each column; row 0, the intercept, is free."""
    fit = gram @ w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            now = linear[j] - fit[j] + gram[j, j] * w[j]
            new = now / max(gram[j, j], 1e-12) if j == 0 else np.sign(now) * np.maximum(np.abs(now) - l1, 0) / (gram[j, j] + l2 + 1e-12)
            moved = new - w[j]
            if moved.any():
                fit += gram[:, j : j + 1] * moved
                w[j] = new
                most = max(most, float(np.abs(moved).max()))
        if most < eps:
            break
    return w


def path(df: DataFrame, label: str, features: str, mix: float = 0.1, penalties: int = PENALTIES, smallest: float = SMALLEST, k: int | None = None, passes: int = PASSES, tolerance: float = TOLERANCE, key: str | None = None) -> Path | None:
    """The path of a multinomial (two classes: binomial, as a pair of opposite coefficients) model of a label on an array of features.

    Loss: mean deviance / 2 + penalty * (mix |w| + (1 - mix) w'w / 2), on features scaled to variance one.
    The penalties fall from the least that keeps all coefficients at zero to
    `smallest` of it; the chosen one is the largest whose held-out deviance is within a standard
    error of the best. Folds go by a hash of `key` (of features and label without it).
    Rows with a null label or features are left out. None for fewer than two classes or folds.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(label).alias("y"), F.transform(features, lambda x: x.cast("double")).alias("x"), *([F.col(key).alias("key")] if key else []))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    classes, n = sorted(counts), sum(counts.values())
    if len(classes) < 2:
        return None
    k = k or folds(n)
    fold = F.pmod(F.xxhash64(*(["key"] if key else ["x", "y"])), F.lit(k)).cast("int")
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int") - 1
    rows = materialize(rows.select(fold.alias("fold"), code.alias("c"), "x"), "path-rows")
    c, width = len(classes), len(rows.first().x) + 1

    def added(job, size: int, *args) -> np.ndarray:
        """What `job` sums over all rows, as one array; tasks send theirs in bytes, and they are added in a tree."""
        part = rows.mapInPandas(lambda it: job(it, *args), "total binary")
        zero = np.zeros(size)
        return part.rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(zero, lambda a, b: a + b, lambda a, b: a + b)

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, width, width))
        hit = np.zeros((k, c))
        for p in parts:
            if len(p):
                x = np.column_stack([np.ones(len(p)), np.stack(p["x"].to_numpy())])
                for f in range(k):
                    on = (p["fold"] == f).to_numpy()
                    total[f] += x[on].T @ x[on]
                np.add.at(hit, (p["fold"].to_numpy(), p["c"].to_numpy()), 1)
        yield pd.DataFrame({"total": [np.concatenate([total.ravel(), hit.ravel()]).tobytes()]})

    sums = added(moments, k * width * width + k * c)
    raw, hit = sums[: k * width * width].reshape(k, width, width), sums[k * width * width :].reshape(k, c)
    if k < 2 or (hit.sum(axis=1) == 0).any():
        return None
    whole = raw.sum(axis=0)
    mean = whole[0] / n
    mean[0] = 0.0
    sd = np.sqrt(np.maximum(np.diag(whole) / n - mean**2, 0))
    sd[0] = 1.0
    sd = np.where(sd > 1e-9, sd, np.inf)  # a constant feature keeps the coefficient zero
    turn = np.diag(1 / sd)
    turn[0, 1:] = -mean[1:] / sd[1:]  # (1, x) @ turn is (1, scaled x)
    gram = np.einsum("ia,fij,jb->fab", turn, raw, turn)
    models = k + 1  # without fold f, then on all
    size = np.array([n - hit[f].sum() for f in range(k)] + [n])
    curve = [(gram.sum(axis=0) - gram[f]) / size[f] for f in range(k)] + [gram.sum(axis=0) / n]
    w = np.zeros((models, width, penalties, c))
    for m in range(models):
        share = (hit.sum(axis=0) - (hit[m] if m < k else 0) + 1e-9) / size[m]
        w[m, 0] = np.log(np.maximum(share, 1e-9)) - np.log(np.maximum(share, 1e-9)).mean()

    def gradients(parts: Iterator[pd.DataFrame], w: np.ndarray) -> Iterator[pd.DataFrame]:
        g, loss = np.zeros((models, width, w.shape[2], c)), np.zeros((k, w.shape[2]))
        for p in parts:
            for lo in range(0, len(p), 1024):
                q = p.iloc[lo : lo + 1024]
                x = np.column_stack([np.ones(len(q)), np.stack(q["x"].to_numpy())]) @ turn
                f, y = q["fold"].to_numpy(), q["c"].to_numpy()
                for m in range(models):
                    on = f != m  # all rows for the last
                    eta = (x @ w[m].reshape(width, -1)).reshape(len(q), -1, c)
                    eta -= eta.max(axis=2, keepdims=True)
                    prob = np.exp(eta)
                    prob /= prob.sum(axis=2, keepdims=True)
                    if m < k and (~on).any():
                        at = prob[~on][np.arange((~on).sum()), :, y[~on]]
                        loss[m] -= 2 * np.log(np.maximum(at, 1e-300)).sum(axis=0)
                    rest = -prob[on]
                    rest[np.arange(on.sum()), :, y[on]] += 1
                    g[m] += (x[on].T @ rest.reshape(on.sum(), -1)).reshape(width, -1, c)
        yield pd.DataFrame({"total": [np.concatenate([g.ravel(), loss.ravel()]).tobytes()]})

    one = w[:, :, :1]
    first = added(gradients, models * width * c + k, one)[: models * width * c].reshape(models, width, c)
    top = float(np.abs(first[k][1:]).max()) / n / max(mix, 1e-3)
    levels = top * smallest ** (np.arange(penalties) / max(1, penalties - 1))
    done, settled, loss, before, pace = 0, False, np.zeros((k, penalties)), w.copy(), 1.0
    live, calm = np.arange(penalties), np.zeros(penalties, int)  # penalties still under way; iterations in a row in which one has hardly moved
    while done < passes and not settled:
        ahead = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        now = w[:, :, live]
        at = now + (pace - 1) / ahead * (now - before[:, :, live]) if done else now  # momentum; the bound holds anywhere
        got = added(gradients, models * width * len(live) * c + k * len(live), at)
        g, loss[:, live] = got[: models * width * len(live) * c].reshape(models, width, len(live) * c), got[models * width * len(live) * c :].reshape(k, len(live))
        new = np.empty_like(at)
        l1, l2 = np.repeat(levels[live] * mix, c), np.repeat(levels[live] * (1 - mix), c)
        for m in range(models):
            bound, v = 0.5 * curve[m], at[m].reshape(width, -1)  # the curvature of a multinomial loss is at most half the Gram matrix
            new[m] = _descend(bound, g[m] / size[m] + bound @ v, v.copy(), l1, l2).reshape(width, len(live), c)
        turned = float(((at - new) * (new - now)).sum()) > 0  # momentum that leads back is dropped
        moved = np.abs(new - now).max(axis=(0, 1, 3))
        before, w = w, w.copy()
        w[:, :, live] = new
        pace, done = 1.0 if turned else ahead, done + 1
        settled = float(moved.max()) < tolerance
        calm[live] = np.where(moved < tolerance, calm[live] + 1, 0)
        live = live[calm[live] < CALM]
    release(rows)
    each = loss / hit.sum(axis=1, keepdims=True)
    deviance = loss.sum(axis=0) / n
    error = each.std(axis=0, ddof=1) / np.sqrt(k)
    best = int(deviance.argmin())
    chosen = int(np.nonzero(deviance <= deviance[best] + error[best])[0][0])
    coefficients = np.einsum("ab,bpc->pca", turn, w[k])
    return Path(classes, levels, coefficients, deviance, error, best, chosen, done, settled)
