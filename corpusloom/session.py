"""Sessions, and sending this package to executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: UTC throughout; adaptive execution sizes and splits shuffled partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session with this engine's settings; keyword settings have "_" for "." in their names."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is missing, a temporary folder is taken, which only a
    local master may use (tests): anywhere else it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there; by: a folder for each value of that column, the last one.

    `release` deletes them when nothing reads them any more.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored(table: DataFrame) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function that reads columns of a table of `materialize`, or of a folder in it, within a task, as record batches.

    It is opened through Arrow's file systems, so the shared folder must be one that Arrow knows (local, HDFS, S3).
    """
    path = table.stored_at

    def read(columns: list[str], folder: str = "") -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        for info in sorted(files.get_file_info(fs.FileSelector(f"{base}/{folder}")), key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(columns=columns)

    return read


def _delete(*tables: DataFrame) -> None:
    for t in tables:
        path = t.__dict__.pop("stored_at", None)
        if path:
            jvm = t.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote, once what was made of them is stored itself.

    The session is also asked to collect what is no longer referred to, by
    which Spark removes the shuffle files of jobs that are done.
    """
    _delete(*tables)
    if tables:
        _COLLECTED[0] = time.monotonic()
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


_COLLECTED = [0.0]


def release_in_loop(*tables: DataFrame, pause: float = 20.0) -> None:
    """As `release`, for loops of short rounds: the session is asked to collect once in so many seconds."""
    if time.monotonic() - _COLLECTED[0] > pause:
        release(*tables)
    else:
        _delete(*tables)
