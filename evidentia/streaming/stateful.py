"""Stateful folds over events: rate limits and sessions, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[int], recent: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Which requests a sliding window lets through; rejected ones do not count. Times in microseconds."""
    out = []
    for t in times:
        recent = [r for r in recent if r > t - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def rate_limited(requests: DataFrame, limit: int = 5, seconds: int = 3600) -> DataFrame:
    """Adds admitted to requests (event_id, client, ts), ordered by ts and event_id within a client.

    Admission depends on earlier admissions, so a client's requests pass one task in order; they stream
    through it in sorted batches with no more state than `limit` times. Requests without a client share one limit;
    those without a time are refused.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, recent = object(), []
        for batch in batches:
            out = []
            for c, t in zip(batch.column("client").to_pylist(), batch.column("micros").to_pylist(), strict=True):
                if c != client:
                    client, recent = c, []
                (ok,), recent = ([False], recent) if t is None else admit([t], recent, limit, seconds * 1_000_000)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("client"), pa.array(out, pa.bool_())], names=["event_id", "client", "admitted"])

    keyed = requests.select(F.col("event_id").cast("long"), F.col("client").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return keyed.repartition("client").sortWithinPartitions("client", "micros", "event_id").mapInArrow(rows, "event_id long, client long, admitted boolean")


def rate_limited_stream(requests: DataFrame, limit: int = 5, seconds: int = 3600) -> DataFrame:
    """rate_limited() for a stream: the state of a client is the times of its admitted requests in the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        ok, recent = admit(rows["micros"].tolist(), recent, limit, seconds * 1_000_000)
        state.update((recent,))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "client": key[0], "admitted": ok})

    keyed = requests.select("event_id", "client", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return keyed.groupBy("client").applyInPandasWithState(step, "event_id long, client long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap_seconds: int = 1800, most_turns: int = 8) -> DataFrame:
    """Per client: events with less than a gap between them form a session; it is completed at the most turns.

    Returns client, session (from 1), started, ended, turns and status (completed or abandoned).
    """
    order = Window.partitionBy("client").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    marked = events.withColumn("session", F.sum(F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("client", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.least(F.count(F.lit(1)), F.lit(most_turns)).alias("turns"), F.when(F.count(F.lit(1)) >= most_turns, F.lit("completed")).otherwise(F.lit("abandoned")).alias("status"))


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """An extension: events per type and hour of their own time, with late ones waited for that long."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
