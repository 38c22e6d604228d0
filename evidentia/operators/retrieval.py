"""Evidence retrieval: exact vector search, keyword lookup, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent to the tasks at once.
QUERY_BLOCK = 2048


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two float arrays, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def distances(queries: DataFrame, corpus: DataFrame, keep: int | None = None, below: float | None = None) -> DataFrame:
    """(query_id, chunk_id, distance) from every query to the corpus rows it keeps.

    Queries (query_id, embedding) go to the tasks in blocks of bounded size; every corpus partition
    (chunk_id, embedding) meets each block in one matrix product and passes on, per batch, only the `keep`
    nearest or those strictly below a distance. A row is no evidence for itself. Distances are rounded to
    nine digits, so that sums in another order do not change ranks; vectors of no length match nothing.
    """
    spark, out = corpus.sparkSession, None
    schema = "query_id long, chunk_id long, distance double"
    names = ["query_id", "chunk_id", "distance"]

    def unit(column) -> tuple[np.ndarray, np.ndarray]:
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        norm = np.sqrt((m * m).sum(axis=1))
        return m / np.where(norm > 0, norm, 1)[:, None], norm > 0

    block: list = []

    def against(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        sent = spark.sparkContext.broadcast((ids, q / np.sqrt((q * q).sum(axis=1))[:, None]))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    m, real = unit(part.column(1))
                    chunk = part.column(0).to_numpy(zero_copy_only=False)
                    far = 1 - q @ m.T
                    far[:, ~real] = np.inf
                    far[ids[:, None] == chunk[None, :]] = np.inf
                    if below is not None:
                        a, b = np.nonzero(far < below + 2e-9)
                    else:
                        k = min(keep, far.shape[1])
                        bound = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                        a, b = np.nonzero(far <= bound + 2e-9)  # ties at the bound stay for now
                    near = np.round(far[a, b], 9)
                    real = np.isfinite(near) if below is None else near < below
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a][real]), pa.array(chunk[b][real]), pa.array(near[real])], names=names)

        return corpus.select(F.col("chunk_id").cast("long"), "embedding").where(F.size("embedding") > 0).mapInArrow(nearest, schema)

    usable = queries.where(F.exists("embedding", lambda x: x != 0)).select(F.col("query_id").cast("long"), "embedding")
    for row in usable.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            part, block = against(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = against(block) if block else spark.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return out


def top_k(ranked: DataFrame, k: int, by: str = "query_id", order: tuple[str, ...] = ("distance", "chunk_id")) -> DataFrame:
    """The first k rows of each list and their ranks; ties are settled by the last column of the order."""
    position = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return ranked.withColumn("rank", position).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    found = distances(queries, corpus, keep=k)
    return top_k(found if threshold is None else found.where(F.col("distance") < threshold), k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists of (query_id, chunk_id, rank): each adds 1 / (k + rank)."""
    a, b = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")), keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 12))


def first_seen(lists: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order (dropDuplicates would keep any)."""
    return lists.withColumn("seen", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("seen = 1").drop("seen")


def with_fallback(first: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """first, and for queries that have fewer than `least` rows there also the rows of other that are new."""
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("query_id")
    added = other.join(enough, "query_id", "left_anti").join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return first.unionByName(added)
