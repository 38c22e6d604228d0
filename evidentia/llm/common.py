"""Helpers that the training-data operators share: reading tables and writing intermediate ones."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that part words: space and the five ASCII controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a new temporary one per application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        name = spark.sparkContext.applicationId
        found = _OWN[name] = _OWN.get(name) or tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/evidentia/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it as read from there.

    This cuts the lineage, so that later steps do not depend on executors that may be lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # for drop()
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that save() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._written_to
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str):
    """Within it, batches that go to Python workers hold so many bytes at most, beyond their last row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of queries that are done: it waits for the driver to collect them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps from task to task; it keeps things for one key alone, so another operator's go."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Returns what Python and Arrow have freed to the system, where the C library can do that."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
