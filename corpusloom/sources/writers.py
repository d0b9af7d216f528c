"""Writers: Parquet, in-place updates, CSV with or without a byte-order mark, JSON, text; a probe before long jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def update_in_place(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites a table by a function of itself: written beside it, then swapped, the old one removed last."""
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    write_parquet(change(spark.read.parquet(path)), new)
    (here, fs), (there, _), (aside, _) = _fs(spark, path), _fs(spark, new), _fs(spark, old)
    if not fs.rename(here, aside):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(there, here):
        fs.rename(aside, here)
        raise OSError(f"{new} can't be moved")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file in any store."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A folder of CSV files, one by default, for report tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_sheet(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """One CSV file with a byte-order mark, for spreadsheets: a coder's sheet, refused above `rows` rows."""
    held = df.limit(rows + 1).toPandas()
    if len(held) > rows:
        raise ValueError(f"more than {rows} rows")
    write_text(df.sparkSession, path, "﻿" + held.to_csv(index=False))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(spark: SparkSession, folder: str, **entry: object) -> None:
    """One line of a run's log, as JSON with the time, in a file of its own under the folder; `spark.read.json(folder)` reads them all."""
    at = datetime.now(UTC).isoformat(timespec="milliseconds")
    write_text(spark, f"{folder}/{at.replace(':', '')}-{uuid.uuid4().hex[:8]}.json", json.dumps({"at": at, **entry}) + "\n")


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A small result as a Markdown table."""
    held = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line(r) for r in held)]) + "\n"


def render(template: str, **values: str) -> str:
    """A template with its __NAME__ marks filled."""
    for k, v in values.items():
        template = template.replace(f"__{k.upper()}__", v)
    return template


def assert_writable(spark: SparkSession, path: str) -> None:
    """Writes and reads one row before a long job does."""
    probe = f"{path}.probe-{uuid.uuid4().hex[:8]}"
    spark.range(1).write.parquet(probe)
    if spark.read.parquet(probe).count() != 1:
        raise OSError(f"{path} can't be read back")
    p, fs = _fs(spark, probe)
    fs.delete(p, True)
