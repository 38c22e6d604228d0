"""Reading tables: Parquet scans, and constant relations that travel with a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant relation: a handful of rows, which Spark sends to every task as it likes."""
    return spark.createDataFrame(rows, schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing else uses, in the one that ``spark.checkpoint.dir`` names; a temporary one where it is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
