"""Helpers that the corpus operators share: inputs, shared scratch tables, column idioms."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch that Python gets, so that long texts come a few at a time. Set where the session says nothing.
BATCH_BYTES = "8m"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_local_dirs: list[tempfile.TemporaryDirectory] = []  # removed when the driver ends
_scratch: list[str] = []


def _bounded(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None and not getattr(spark, "_bounded_batches", False):
        spark.conf.set(name, BATCH_BYTES)
        spark._bounded_batches = True


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a context: they need not have it installed."""
    _bounded(spark)
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    if getattr(context, "_shipped_package", False) or not root.is_dir():
        return
    _local_dirs.append(tempfile.TemporaryDirectory(prefix="package-"))
    path = f"{_local_dirs[-1].name}/{root.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    found = list(sys.path)
    context.addPyFile(path)  # the driver's file server hands it out; the driver itself goes on with its own
    sys.path[:] = found
    context._shipped_package = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone so that any store it knows will do."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the session names none (tests in local mode, where there is one machine) a temporary
    folder is made and set as the checkpoint folder; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _scratch:
        _local_dirs.append(tempfile.TemporaryDirectory(prefix="corpus-scratch-"))
        _scratch.append(f"file://{_local_dirs[-1].name}")
    return _scratch[0]


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def light(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """A written table, to be broadcast in joins if its counted rows, of about so many bytes, are below a bound."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def trim() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow, as it is, that trims at its end: Python workers are kept for other tasks, and what one
    operator's tasks have left in them would count against the next one's."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it.

    A lambda variable is not inlined by the optimizer, unlike a column of an earlier projection.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. In ASCII texts that is lower(), which takes a byte at a time and no lookup."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def split_words(text: Column, separators: str = SPACE_RUN) -> Column:
    """The maximal runs of characters outside the separator run; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def steps(count: Column) -> Column:
    """1 .. count, empty where count is below 1."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
