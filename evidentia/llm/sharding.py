"""Contiguous shards of nearly equal byte size, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def assign(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in its shard) to every row.

    Rows stand in the given order and are cut where the running total of their sizes passes equal shares:
    a row belongs to the share its middle byte lies in, so a shard misses its share by less than one row at
    either end. The rows are range-partitioned once and written; then only one total per range is needed to
    turn running sums within ranges into global ones, and no task ever holds more than one range. Rows that
    are equal in every column of the order are interchangeable. A row larger than a share leaves shards
    empty; an empty table stays empty. Null keys come first.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(common.shuffle_partitions(spark), *order).withColumn("range_id", F.spark_partition_id())
    ranged = common.save(ranged, "ranges")
    # one row per partition: small whatever the number of documents
    by_range = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_id").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    bases = totals.select("range_id", F.coalesce(F.sum("bytes").over(by_range), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("base_rows"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    within = Window.partitionBy("range_id").orderBy(*order)
    placed = ranged.withColumns({"end_in_range": F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)), "row_in_range": F.row_number().over(within)}).join(F.broadcast(bases), "range_id")
    middle = 2 * (F.col("base_bytes") + F.col("end_in_range")) - F.col(size)
    placed = placed.withColumns({"shard": F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("all_bytes")))).cast("int"), "row": F.col("base_rows") + F.col("row_in_range") - 1})
    placed = common.save(placed.drop("range_id", "end_in_range", "row_in_range", "base_bytes", "base_rows", "all_bytes"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row") - F.col("first_row")).drop("row", "first_row")


def measured(docs: DataFrame) -> DataFrame:
    """size: UTF-8 bytes of the text plus one (null: one); text_crc32: of these bytes (null: of none)."""
    text = common.text_or_empty()
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def write(docs: DataFrame, path: str, n_shards: int) -> None:
    """Writes the documents in one folder per shard, by slot within it; every column is kept but one named shard."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    keyed = measured(docs.select("doc_id", "text", F.struct(*own).alias("own"))).drop("text")
    placed = assign(keyed, n_shards, ["doc_id", "size", "text_crc32"])
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("own.*", "shard").write.partitionBy("shard").parquet(path)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32")
    placed = assign(rows, 16, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


