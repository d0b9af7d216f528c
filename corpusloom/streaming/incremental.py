"""Resumable work: what a results table already holds is skipped, so a job can be run again at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.annotate import uncached
from ..sources.readers import optional


def resume(spark: SparkSession, batches: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Works off the batches (cache_key, ...) that the table at `path` lacks, appends the results, and returns the table."""
    held = optional(spark, path)
    todo = batches if held is None else uncached(batches, held)
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
