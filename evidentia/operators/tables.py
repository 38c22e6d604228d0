"""Changes of tables, as new versions of them: upserts, seeds, caches, deletes and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.asof import latest


def upserted(now: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """now with the rows of new put in: per key the row that stands last in the order, new ones winning ties."""
    both = now.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, [*[F.desc(c) for c in order], F.desc("_new")]).drop("_new")


def changed(now: DataFrame, seed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """What a seed would do: the key, and insert, update, keep or (for rows that it lacks) absent."""
    a, b = now.alias("a"), seed.alias("b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    first = key[0]
    action = F.when(F.col(f"a.{first}").isNull(), F.lit("insert")).when(F.col(f"b.{first}").isNull(), F.lit("absent")).when(same, F.lit("keep")).otherwise(F.lit("update"))
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], action.alias("action"))


def cached(entries: DataFrame, now: Column) -> DataFrame:
    """The entries that have not run out; one that runs out just now is a miss."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def cache_key(namespace: str, model: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.concat(model, F.lit("\0"), text), 256))


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those that a deleted parent takes along."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in order; parents without any get an empty one."""
    fields = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
