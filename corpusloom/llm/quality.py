"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

One pass computes about two dozen statistics of each whole text. They are
standardised with means and deviations of all documents, and mapped to random
Fourier features, whose inner products approximate a Gaussian kernel. Every
partition of the labelled rows sums its part of the normal equations; the sums
of the parts, of fixed size, give the ridge weights. Scores are quantised, and
pool-adjacent-violators over the bins of a fold that the fit has not seen
turns them into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, load, materialize, slices, slim

FEATURES = 192
RIDGE = 1e-3
BINS = 512
SEED = 7

_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" ", "line": b"\n", "stop": b".,;:", "loud": b"!?", "pipe": b"|", "sign": b"#$%&*@^~=+_", "bracket": b"()[]{}<>/\\", "quote": b"\"'`"}
_GROUP_INDEX = [np.frombuffer(v, np.uint8) for v in _GROUPS.values()]
NAMES = ("log_bytes", "log_words", "word_length", "word_deviation", "distinct_words", "top_word", "repeated_next", "log_lines", "line_words", "distinct_lines", "short_lines", "end_stops", "byte_entropy", "beyond_ascii", *(f"share_{k}" for k in _GROUPS))


def statistics(text: str) -> list[float]:
    """The statistics named by NAMES of a whole text; finite for any text, the empty one included."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = count[count > 0] / n
    words = text.split()
    w = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), float(size.mean()), float(size.std()), len(kinds) / w, max(kinds.values(), default=0) / w, again / w,
        math.log1p(len(lines)), math.log1p(len(words) / k), len(set(lines)) / k, sum(len(x) < 30 for x in lines) / k, sum(x[-1] in ".!?" for x in lines) / k,
        float(-(p * np.log2(p)).sum()) if raw else 0.0, float(count[128:].sum()) / n, *(float(count[g].sum()) / n for g in _GROUP_INDEX),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): the statistics of each whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [statistics(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "stats"])

    return slim(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, stats array<double>")


class FourierMap:
    """Standardises statistics and maps them to random Fourier features of a Gaussian kernel; all drawn from the seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.w = rng.normal(0, 1 / math.sqrt(d), (d, features))
        self.phase = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def normal_equations(rows: DataFrame, mapper: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'y) of rows (stats, label): each partition sums its own, then each row of the matrix is summed."""
    side = FEATURES + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side + 1))
        for b in batches:
            if b.num_rows:
                x = mapper(_matrix(b.column(0)))
                total[:, :side] += x.T @ x
                total[:, side] += x.T @ b.column(1).to_numpy(zero_copy_only=False).astype(float)
        if total[-1, side - 1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(side, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), strict=True):
                total[i] = total.get(i, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select("stats", "label").mapInArrow(local, "i int, v array<double>")
    out = np.zeros((side, side + 1))
    for i, v in parts.repartition("i").mapInArrow(merge, "i int, v array<double>").collect():  # one row for each row of the matrix
        out[i] = v
    return out[:, :side], out[:, side]


def _pooled(centre: np.ndarray, positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Blocks (centre, positive, total) in order, whose rates rise from each to the next."""
    blocks: list[list[float]] = []
    for x, a, n in zip(centre, positive, total, strict=True):
        blocks.append([x * n, a, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    out = np.array(blocks)
    out[:, 0] /= out[:, 2]
    return out


def isotonic(position: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: the centre and the rate of each block.

    Half a case of either label is added to each block, so that no rate is 0
    or 1; a small block moves more by that than a large one, so blocks are
    pooled once more and rates rise strictly.
    """
    x, a, n = _pooled(position, positive, total).T
    x, a, n = _pooled(x, a + 0.5, n + 1).T
    return x, a / n


def fit_and_score(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, raw, score): scores of all rows of stats (id, stats), fitted to labels (id, label, calibrate).

    Labels with a null id or label are left out; several labels of one id
    count each. Rows where calibrate holds set the calibration alone. Without
    a row to fit or to calibrate by, the score is the mean label of what
    there is (0.5 without any).
    """
    mean, deviation = np.zeros(len(NAMES)), np.ones(len(NAMES))
    at = stats.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    for i, m, s in at.collect():  # one row for each statistic
        mean[i], deviation[i] = m, s
    mapper = FourierMap(mean, deviation)
    known = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).select(id_col, "label", "calibrate")
    known = materialize(stats.join(known, id_col).select(id_col, "stats", F.col("label").cast("double").alias("label"), "calibrate"), "labelled")
    a, b = normal_equations(known.where("not calibrate"), mapper)
    n = a[-1, -1]
    weights = np.linalg.solve(a + RIDGE * max(n, 1) / FEATURES * np.eye(len(a)), b) if n else np.zeros(len(a))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            value = mapper(_matrix(r.column(1))) @ weights if r.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(2), pa.array(value)], [id_col, "label", "raw"])

    kind = stats.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, label double, raw double"
    binned = F.least(F.greatest(F.floor((F.col("raw") + 1) / 3 * BINS), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    held = known.where("calibrate").select(id_col, "stats", "label").mapInArrow(raw, schema)
    bins = sorted(held.groupBy(binned).agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"), F.avg("raw").alias("x")).collect())  # at most BINS rows
    if bins:
        x, y = isotonic(np.array([r["x"] for r in bins]), np.array([r["a"] for r in bins]), np.array([r["n"] for r in bins]))
    else:
        x, y = np.zeros(1), np.array([b[-1] / n if n else 0.5])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in raw(batches):
            value = r.column(2).to_numpy(zero_copy_only=False)
            # ranks within a block follow the raw score by a hair, so that equal rates still order
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(2), pa.array(np.clip(np.interp(value, x, y) + 1e-6 * np.tanh(value), 0, 1))], [id_col, "raw", "score"])

    return stats.select(id_col, "stats", F.lit(None).cast("double").alias("label")).mapInArrow(score, f"`{id_col}` {kind}, raw double, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, raw, score) for every row of docs; labels: (id, label, calibrate).

    A null text scores as the empty one; texts of any length count whole; null
    ids, repeated rows and ties are scored each on its own; an empty table
    gives an empty result; extra columns are ignored.
    """
    return fit_and_score(materialize(document_statistics(docs, id_col, text_col), "stats"), labels, id_col)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    labels = labels.select("doc_id", F.col("quality").alias("label"), (fold("doc_id", 5) == 1).alias("calibrate"))
    scored = quality_scores(load(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
