"""State of objects from edits that are only ever added: merge patches (RFC 7386) replayed up to any time."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_COLUMNS = "path array<string>, value string, ends boolean"


def leaves_of(patch: str) -> list[tuple[list[str], str | None, bool]]:
    """What a patch says: (path, value as JSON or null, whether all below the path goes). Text that is no JSON says nothing.

    An empty object only says that its path holds an object.
    """
    try:
        todo = [([], json.loads(patch))]
    except ValueError:
        return []
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [([*path, k], v) for k, v in value.items()]
        elif isinstance(value, dict):
            out.append((path, None, False))
        else:
            out.append((path, None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")), True))
    return out


def leaves(edits: DataFrame, key: str, at: str, number: str) -> DataFrame:
    """(key, at, number, path, value, ends) of every edit's patch. Equal edits count once; of different patches under one
    key, time and number the greater text counts; edits without patch or time are passed over."""
    one = edits.where(F.col("patch").isNotNull() & F.col(at).isNotNull()).groupBy(key, at, number).agg(F.max("patch").alias("patch"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema if f.name != "patch")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [leaves_of(p) for p in batch.column("patch").to_pylist()]
            which = pa.array([i for i, s in enumerate(said) for _ in s], pa.int64())
            flat = [x for s in said for x in s]
            kept = [batch.column(c).take(which) for c in (key, at, number)]
            new = [pa.array([x[0] for x in flat], pa.list_(pa.string())), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[key, at, number, "path", "value", "ends"])

    return one.mapInArrow(rows, f"{schema}, {_COLUMNS}")


def states(edits: DataFrame, instants: list[dt.datetime], key: str = "key", at: str = "at", number: str = "number") -> DataFrame:
    """(key, instant, path, value) of the objects as the edits (key, at, number, patch) up to each instant left them.

    Edits apply by time, then number. A value is there if its edit is the last on its path, no later one replaced or
    took away what it stands in, and none put something below it; an edit to null takes the value away. Only values
    are told, so an object that has none left is not. Per key no more is gathered than its paths.
    """
    stamp = F.struct(F.col(at).alias("at"), F.col(number).alias("number"))
    times = F.array(*[F.lit(i).cast(edits.schema[at].dataType) for i in instants])
    said = leaves(edits, key, at, number).withColumn("instant", F.explode(F.filter(times, lambda i: i >= F.col(at))))
    last = said.groupBy(key, "instant", "path").agg(F.max(stamp).alias("own"), F.max_by("value", stamp).alias("value"), F.max(F.when(F.col("ends"), stamp)).alias("cut"))
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    inner = last.where(F.size("path") > 0).withColumn("over", F.explode(above))
    # the last word on anything below a path, and the last cut on anything above it
    below = inner.groupBy(key, "instant", F.col("over").alias("path")).agg(F.max("own").alias("below"))
    cuts = last.where("cut IS NOT NULL").select(F.col(key).alias("_k"), F.col("instant").alias("_i"), F.col("path").alias("over"), F.col("cut").alias("above"))
    met = (inner["over"] == cuts["over"]) & inner[key].eqNullSafe(cuts["_k"]) & (inner["instant"] == cuts["_i"])
    over = inner.join(cuts, met).groupBy(key, "instant", "path").agg(F.max("above").alias("above"))
    out = last.alias("l")
    for found, name in ((below, "b"), (over, "o")):
        found = found.alias(name)
        same = F.col(f"l.{key}").eqNullSafe(F.col(f"{name}.{key}")) & (F.col("l.instant") == F.col(f"{name}.instant")) & (F.col("l.path") == F.col(f"{name}.path"))
        out = out.join(found, same, "left")
    stands = F.col("l.value").isNotNull() & F.coalesce(F.col("own") > F.col("below"), F.lit(True)) & F.coalesce(F.col("own") > F.col("above"), F.lit(True))
    return out.where(stands).select(f"l.{key}", "l.instant", "l.path", "l.value")


def trail(edits: DataFrame, key: str, at: str, number: str, most: int = 20) -> DataFrame:
    """Per key the count of its edits and the latest of them, at most `most`, oldest first, as an array of (at, number, patch)."""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(number), F.desc("patch"))
    ranked = edits.withColumn("_n", F.row_number().over(order))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n_edits"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct(at, number, "patch")))).alias("edits"))
