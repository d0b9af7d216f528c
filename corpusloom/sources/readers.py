"""Readers: NDJSON with explicit fields, CSV of several kinds, Parquet, caches, line files, optional and fallback sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

# The declared fields of the raw comment records.
COMMENT_FIELDS = [
    *((n, t.StringType()) for n in ("id", "link_id", "parent_id", "subreddit", "author", "author_fullname", "body", "permalink", "edited", "distinguished")),
    *((n, t.LongType()) for n in ("created_utc", "score", "controversiality")),
    *((n, t.BooleanType()) for n in ("is_submitter", "stickied")),
]
COMMENTS = t.StructType([t.StructField(n, k) for n, k in COMMENT_FIELDS])


def read_ndjson(spark: SparkSession, paths: str | list[str], schema: t.StructType = COMMENTS) -> DataFrame:
    """The declared fields of each record; malformed lines are dropped (count_malformed tells how many)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def count_malformed(spark: SparkSession, paths: str | list[str], schema: t.StructType = COMMENTS) -> int:
    bad = t.StructType([*schema.fields, t.StructField("_bad", t.StringType())])
    rows = spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    return rows.agg(F.count_if(F.col("_bad").isNotNull()).alias("n"), F.max(schema.fieldNames()[0])).first().n


def ingest_comments(raw: DataFrame) -> DataFrame:
    """Raw records with time, month (UTC), thread name, level and length."""
    from ..functions.text import thread_slug

    ts = F.timestamp_seconds("created_utc")
    return raw.withColumns({"created_ts": ts, "ym": F.date_format(ts, "yyyy-MM"), "thread_slug": thread_slug(F.col("permalink")), "is_top_level": F.col("parent_id").like("t3_%"), "n_chars": F.length("body").cast("long")})


def read_strings(spark: SparkSession, path: str, columns: list[str], nulls: str | None = None) -> DataFrame:
    """A CSV file with all columns as text, for cells that people typed; a byte-order mark is skipped.

    Empty cells are empty texts, or null where `nulls` is the empty text.
    """
    reader = spark.read.schema(t.StructType([t.StructField(c, t.StringType()) for c in columns])).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", True)
    if nulls is not None:
        return reader.option("nullValue", nulls).option("emptyValue", nulls).csv(path)
    return reader.csv(path).fillna("")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file without blank ones and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).where((F.length("line") > 0) & ~F.col("line").startswith("#"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def preferred(spark: SparkSession, paths: list[str], first: Callable[[], DataFrame], otherwise: Callable[[], DataFrame]) -> DataFrame:
    """The first query if all that it reads exists, else the other."""
    return first() if all(exists(spark, p) for p in paths) else otherwise()


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows under the given ids: a semi-join, however many ids there are."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def read_cache(spark: SparkSession, path: str, result: str) -> DataFrame:
    """Cached annotation batches (cache_key, ids, results as JSON) with their results parsed."""
    return spark.read.parquet(path).withColumn("results", F.transform("results", lambda r: F.from_json(r, result)))


def read_json_cache(spark: SparkSession, glob: str, result: str) -> DataFrame:
    """(cache_key, position, result...) of annotation batches kept as JSON files {"cache_key", "results"}: one row a result; files that are no JSON are left out."""
    batches = spark.read.schema(f"cache_key string, results array<struct<{result}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
    return batches.select("cache_key", F.posexplode("results").alias("position", "r")).select("cache_key", F.col("position").cast("long").alias("position"), "r.*")


def wide_vector(df: DataFrame, prefix: str, out: str = "embedding") -> DataFrame:
    """Columns prefix0, prefix1, ... gathered as one array column."""
    names = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*(c for c in df.columns if c not in names), F.array(*names).alias(out))
