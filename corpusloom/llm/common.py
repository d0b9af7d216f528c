"""What the training-data operators share: reading tables, the shared folder, folds and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path, release, shared_dir

__all__ = ["fold", "join_uneven", "load", "materialize", "new_path", "partitions", "release", "shared_dir", "slices", "slim", "tidy"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, max(1, b.num_rows), rows):
            yield b.slice(lo, rows)


def tidy() -> None:
    """Gives freed memory back to the system; workers are used again, beside the JVM and others of their kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones never travel."""
    return docs.select(*columns)


def join_uneven(left: DataFrame, right: DataFrame, key: str, joins: Column, share: int = 1000) -> DataFrame:
    """left with right's other columns, null where no row matches, however uneven the keys of left are.

    right has one row a key, and in n__ the number of left's rows of it. Keys
    with more than one in `share` of left's rows are fewer than `share`, and are broadcast; the
    others meet their rows by a shuffle, in which the rows that do not join
    (`joins` false or null) or have met already are spread. Rows of left travel once and
    aren't sorted.
    """
    total = left.count()
    many = F.col("n__") * share > total
    values = [c for c in right.columns if c not in (key, "n__")]
    hot = right.where(many).select(F.col(key).alias("key__"), F.struct(*values).alias("hot__"))
    rest = right.where(~many).select(F.col(key).alias("key__"), F.struct(*values).alias("rest__"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("key__"), "left").drop("key__")  # fewer than `share` rows
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    spread = met.withColumn("with__", F.when(joins & F.col("hot__").isNull(), F.concat(F.lit("+"), F.col(key))).otherwise(own))
    rest = rest.withColumn("key__", F.concat(F.lit("+"), F.col("key__"))).hint("shuffle_hash")
    out = spread.join(rest, F.col("with__") == F.col("key__"), "left")
    return out.select(*left.columns, *(F.coalesce(F.col("hot__")[c], F.col("rest__")[c]).alias(c) for c in values))
