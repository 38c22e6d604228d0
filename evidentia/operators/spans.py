"""Choosing among overlapping spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of spans (key, start, end, rank, ...), those that a greedy choice keeps: by rank, then longer, then earlier ones.

    A span is kept if it overlaps none that was kept before it. Spans that hang together by overlaps are chosen
    among apart from all others, so a fold goes over such a cluster alone, however many spans a key has. Empty
    spans overlap nothing. Equal spans of a rank count as one, the first by their other columns' order.
    """
    others = [c for c in spans.columns if c not in (key, "start", "end", "rank")]
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cluster = F.sum(F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct("rank", (-(F.col("end") - F.col("start"))).alias("shorter"), "start", "end", *others)
    grouped = spans.withColumn("cluster", cluster).groupBy(key, "cluster").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return grouped.select(key, F.inline(kept)).select(*spans.columns)
