"""Writing batches of a stream to several tables so that a batch which comes again, or stops half-way, does no harm.

A batch goes to `<folder>/<table>/batch_id=<n>`, which a repeated attempt overwrites whole. When all tables stand, one
record of the batch is written; readers see only batches that have one, so the tables change together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RECORD = "query string, table string, n_rows long"
Split = dict[str, Callable[[DataFrame], DataFrame]]


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The commit records (query, table, n_rows, batch_id); none before the first batch."""
    try:
        return spark.read.schema(f"{RECORD}, batch_id long").parquet(f"{folder}/_commits_of_batches")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{RECORD}, batch_id long")


def write_batch(batch: DataFrame, batch_id: int, folder: str, query: str, split: Split) -> bool:
    """Writes the batch to the tables of split, unless it has been committed; tells whether it wrote."""
    spark = batch.sparkSession
    if not records(spark, folder).where((F.col("batch_id") == batch_id) & (F.col("query") == query)).isEmpty():
        return False
    batch.persist()
    try:
        done = []
        for name, of in split.items():
            counted = Observation()
            of(batch).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
            done.append((query, name, counted.get["n"]))
    finally:
        batch.unpersist()
    spark.createDataFrame(done, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_commits_of_batches/batch_id={batch_id}")
    return True


def fanned_out(stream: DataFrame, folder: str, query: str, split: Split) -> DataStreamWriter:
    """A writer that sends each batch of the stream to the tables of split; its checkpoint lies beside them.

    One folder takes one query, as batches of another have the same numbers; a second one is refused.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        others = records(batch.sparkSession, folder).where(F.col("query") != query)
        if not others.isEmpty():
            raise ValueError(f"{folder} holds batches of another query than {query}")
        write_batch(batch, batch_id, folder, query, split)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")


def committed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table from batches that were committed, with their batch_id."""
    known = records(spark, folder).where(F.col("table") == table).select("batch_id").distinct()
    return spark.read.parquet(f"{folder}/{table}").withColumn("batch_id", F.col("batch_id").cast("long")).join(known, "batch_id", "left_semi")


def _stages(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode("stages").alias("pos", "s")).select("case_id", "pos", "s.*")


def _claims(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode("claims").alias("pos", "c")).select("case_id", "pos", "c.claim_id", "c.text", F.coalesce(F.size("c.bindings"), F.lit(0)).alias("n_bindings"))


def _bindings(cases: DataFrame) -> DataFrame:
    claims = cases.select("case_id", F.explode("claims").alias("c"))
    return claims.select("case_id", "c.claim_id", F.posexplode("c.bindings").alias("pos", "b")).select("case_id", "claim_id", "pos", "b.*")


def _areas(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode(F.array_distinct("areas")).alias("pos", "area")).withColumn("is_primary", F.col("pos") == 0)


#: How an analysed case (case_id, status, stages, claims with bindings, areas) becomes rows; null or empty lists give none.
CASE_TABLES: Split = {"cases": lambda c: c.select("case_id", "status"), "stages": _stages, "claims": _claims, "bindings": _bindings, "areas": _areas}
