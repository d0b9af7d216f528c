"""Importance resampling towards a target distribution, by hashed word runs.

Each text's runs of words fall into buckets by their CRC-32 (`crc`); counts of
the buckets in the raw texts and in the target texts give each bucket a gain,
a text's weight is the sum of its runs' gains, and Gumbel noise by a hash of
the id turns the highest scores into a draw without replacement in proportion
to the weights' exponentials.

Two passes over the texts: one sends a count for each bucket and task, the
other a row for each text. Only the buckets' counts come to the driver. Ranks
are numbered within ranges of the scores, ties by a hash of where a row is
stored, so repeated ids and equal scores spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import ranked
from .common import load, materialize, release
from .crc import LOWER, WORD, run_crcs, words

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Weights and noise are whole numbers, in units of 1 / SCALE.
SCALE = 1000
#: Bytes of text that are worked on at a time.
BLOCK = 1 << 21


def _parts(data: np.ndarray, most: int, block: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts cut where words end, and how many of a part's first words the part before it had as its last."""
    at, carried, fresh = 0, 0, 0
    while at < len(data):
        fresh = min(fresh + block, len(data))
        while fresh < len(data):  # on to the next byte that is in no word
            rest = np.flatnonzero(WORD[data[fresh : fresh + block]] == 0)
            if len(rest):
                fresh += int(rest[0])
                break
            fresh = min(fresh + block, len(data))
        yield data[at:fresh], carried
        if fresh == len(data):
            return
        starts = words(data[at:fresh], np.array([0, fresh - at]))[0]
        keep = min(most - 1, len(starts))
        at, carried = (at + int(starts[len(starts) - keep]) if keep else fresh), keep


def bucketed(texts: pa.Array, buckets: int, most: int, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, text of each run, bucket of each run, words by text): blocks of texts; a long text comes in several.

    texts: an Arrow array of strings; a null text has no words.
    """
    column = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + block, side="right")) - 1)
        cut = data[bounds[lo] : bounds[hi]]
        for part, carried in _parts(cut, most, block) if hi == lo + 1 and len(cut) > block else [(cut, 0)]:
            at = bounds[lo : hi + 1] - bounds[lo] if carried == 0 and len(part) == len(cut) else np.array([0, len(part)])
            low = LOWER[part]
            of = words(low, at)[2]
            found = [(of[last], crc) for last, crc in ((last[last >= carried], crc[last >= carried]) for last, crc in run_crcs(low, at, most))]
            text, crc = (np.concatenate(x) for x in zip(*found, strict=True))
            yield lo, hi - lo, text, (crc % np.uint32(buckets)).astype(np.int64), np.bincount(of[carried:], minlength=hi - lo)
        lo = hi


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """(bucket, n): how often runs of 1 to most_words words of all texts fall into each bucket; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, found, _ in bucketed(b.column(0), buckets, most_words):
                total += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's smoothed log ratio of target to raw share, in thousandths rounded down."""
    s, t = sum(raw.values()), sum(target.values())
    ratio = [(target.get(b, 0) + 1.0) * (s + buckets) / ((raw.get(b, 0) + 1.0) * (t + buckets)) for b in range(buckets)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, [kept columns,] n_words, n_features, weight): the sum of the gains of each text's runs."""
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    names = [*columns, "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, rows, text, bucket, own in bucketed(b.column(len(columns)), len(gain), most_words):
                n[lo : lo + rows] += own
                runs[lo : lo + rows] += np.bincount(text, minlength=rows)
                order = np.argsort(text, kind="stable")  # runs of one length come after those of another
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.cumsum(np.bincount(text, minlength=rows))
                weight[lo : lo + rows] += total[ends] - total[np.concatenate([[0], ends[:-1]])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(n), pa.array(runs), pa.array(weight)], names)

    return docs.select(*columns, F.col(text_col).alias("text__")).mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, [kept columns,] n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Drawn are the highest scores, `percent` of 100 of the documents that have
    least_words words. Null and empty texts have no runs and weight 0. Repeated
    rows are documents of their own, with equal scores; ties go to the smaller
    id, null ids last (as an empty text in the hash), then by a fixed order.
    Texts of any length are read whole. An empty table gives an empty result,
    an empty target a draw by what is rare. Extra columns are ignored but for
    `keep`, which the result takes along (the drawn texts, say).
    """
    taken = lambda df, c: {r["bucket"]: r["n"] for r in bucket_counts(df, c, buckets, most_words).collect()}  # noqa: E731 - at most a row a bucket
    gain = gains(taken(docs, text_col), taken(target, target_col), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-float(SCALE) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    weighed = materialize(weigh(docs, gain, id_col, text_col, most_words, keep).withColumn("score", F.col("weight") + noise), "weighed")
    fit = F.col("n_words") >= least_words
    draws = percent * weighed.where(fit).count() // 100
    columns = weighed.columns
    placed = weighed.select(*columns, F.lit(0).alias("all__"), (~fit).alias("unfit__"), (-F.col("score")).alias("down__"), F.col(id_col).isNull().alias("last__"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("tie__"))
    out = ranked(placed, "all__", "unfit__", "down__", "last__", id_col, "tie__", name="rank__")
    release(weighed)
    kept = [c for c in columns if c not in ("n_words", "n_features", "weight", "score")]
    return out.select(*kept, "n_features", "weight", "score", F.when(fit & (F.col("rank__") <= draws), F.col("rank__")).alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS r, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(r ORDER BY i) AS entry FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents),
flat AS (SELECT i, unnest(w) AS word FROM d),
dw AS (SELECT word, count(*) AS s FROM flat GROUP BY word),
tw AS (SELECT word, count(*) AS t FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY word),
v AS (SELECT word, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(word)) AS x FROM dw FULL JOIN tw USING (word)),
hashed AS (
  SELECT word, s, t, xor(4294967295, list_reduce(list_transform(range(strlen(word)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda r, b: xor(r >> 8, entry[1 + (xor(r, b) & 255)]), CAST(4294967295 AS BIGINT))) % {BUCKETS} AS bucket
  FROM v, crc),
b AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor({SCALE} * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM b),
wg AS (SELECT i, sum(gain) AS weight FROM flat JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY i),
u AS (
  SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
    CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN wg USING (i)),
sc AS (SELECT doc_id, n, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-{SCALE}.0 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n >= {LEAST_WORDS}) OVER () AS fit FROM sc)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= {PERCENT} * fit // 100 THEN place END AS rank FROM r"""
