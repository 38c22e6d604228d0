"""The interview that precedes a case, as a state machine: turns up to a cap, ended by a confirmation, a restart or silence.

An interview is open until it is completed (confirmed, or at its cap of turns) or abandoned (restarted, or left alone
for longer than the gap). Turns after its completion are refused until it ends. `interviews` folds a table and
`interviews_stream` a stream; both give the same rows for all events that come within the watermark.

Events have client, event_id (long), ts and action: confirm, restart, and all else, null included, is a turn. They are
ordered by ts and event_id. Rows that repeat both for a client count once, with the alphabetically first action; rows
without client, event_id or ts are passed over. Times of results are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Width of the stretches of time in which the rows of one client are looked at apart from each other.
STRETCH = 86_400_000_000
RESULT = "client long, first_event long, started long, ended long, turns long, refused long, status string"


def _events(events: DataFrame) -> DataFrame:
    action = F.when(F.col("action").isin("confirm", "restart"), F.col("action")).otherwise(F.lit("turn"))
    rows = events.select(F.col("client").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))
    return rows.where("client IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").withColumn("micros", F.unix_micros("ts"))


def interviews(events: DataFrame, gap_seconds: int = 1800, most_turns: int = 8) -> DataFrame:
    """One row per interview: client, first_event, started, ended (last event that counted), turns, refused, status.

    Nothing is left open: what the table ends in counts as abandoned or completed. Windows span one client's stretch of
    time; one row a stretch carries the last event and the last start over to later ones, so a client that holds
    most rows is spread over tasks.
    """
    rows = _events(events).groupBy("client", "micros", "event_id").agg(F.min("action").alias("action")).withColumn("_stretch", F.floor(F.col("micros") / STRETCH))
    within = Window.partitionBy("client", "_stretch").orderBy("micros", "event_id")
    across = Window.partitionBy("client").orderBy("_stretch")
    lasts = rows.groupBy("client", "_stretch").agg(F.max(F.struct("micros", "event_id", "action")).alias("_last"))
    before = lasts.select("client", "_stretch", F.lag("_last").over(across).alias("_before"))
    rows = rows.withColumn("_prev", F.lag(F.struct("micros", "event_id", "action")).over(within)).join(before, ["client", "_stretch"])
    prev = F.coalesce("_prev", "_before")
    begins = prev.isNull() | (F.col("micros") - prev["micros"] > gap_seconds * 1_000_000) | (prev["action"] == "restart")
    rows = rows.withColumn("_start", F.when(begins, F.struct("micros", "event_id"))).drop("_prev", "_before")
    starts = rows.groupBy("client", "_stretch").agg(F.max("_start").alias("_s"))
    carried = starts.select("client", "_stretch", F.max("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.max("_start").over(upto)).join(carried, ["client", "_stretch"]).withColumn("_of", F.coalesce("_own", "_carried"))
    rows = rows.select("client", F.col("_of.micros").alias("started"), F.col("_of.event_id").alias("first_event"), "micros", "event_id", "action")
    order = Window.partitionBy("client", "started", "first_event").orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.col("action") != "restart"
    rows = rows.withColumn("_k", F.sum(turn.cast("long")).over(order))
    done = turn & ((F.col("action") == "confirm") | (F.col("_k") == most_turns))
    # completed once an earlier turn has ended it
    rows = rows.withColumn("_late", turn & F.coalesce(F.max(done).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    status = F.when(F.max(~turn), F.lit("abandoned")).when(F.max(done), F.lit("completed")).otherwise(F.lit("abandoned"))
    found = rows.groupBy("client", "started", "first_event").agg(
        F.max(F.when(~F.col("_late"), F.col("micros"))).alias("ended"),
        F.count_if(turn & ~F.col("_late")).alias("turns"),
        F.count_if("_late").alias("refused"),
        status.alias("status"),
    )
    return found.select("client", "first_event", "started", "ended", "turns", "refused", "status")


class Interview:
    """The open interview of a client, event by event. Fields of `now` are first_event, started, ended, seen, turns, refused, status."""

    def __init__(self, gap: int, most: int, now: tuple | None = None) -> None:
        self.gap, self.most, self.now = gap, most, now

    def _end(self, status: str) -> tuple:
        first, started, ended, _, turns, refused, _ = self.now
        self.now = None
        return first, started, ended, turns, refused, status

    def passed(self, micros: int) -> list[tuple]:
        """Time has come to this point: what has ended by it."""
        if self.now is None or micros - self.now[3] <= self.gap:
            return []
        return [self._end("completed" if self.now[6] == "completed" else "abandoned")]

    def event(self, micros: int, event_id: int, action: str) -> list[tuple]:
        out = self.passed(micros)
        first, started, ended, _, turns, refused, status = self.now or (event_id, micros, micros, micros, 0, 0, "open")
        if action == "restart":
            self.now = (first, started, micros, micros, turns, refused, status)
            return [*out, self._end("abandoned")]
        if status == "completed":
            refused += 1
        else:
            turns, ended = turns + 1, micros
            status = "completed" if action == "confirm" or turns >= self.most else "open"
        self.now = (first, started, ended, micros, turns, refused, status)
        return out


class _Processor(StatefulProcessor):
    """Events wait until the watermark has passed them, so that they are folded in order; state of a client without an
    open interview and without waiting events is dropped."""

    def __init__(self, gap_seconds: int, most_turns: int, progress: bool) -> None:
        self.gap, self.most, self.progress = gap_seconds * 1_000_000, most_turns, progress

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_event long, started long, ended long, seen long, turns long, refused long, status string")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, action string")

    def _fold(self, key: tuple, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        interview = Interview(self.gap, self.most, tuple(self.open.get()) if self.open.exists() else None)
        held = {}
        for micros, event_id, action in [*(self.waiting.get() if self.waiting.exists() else ()), *new]:
            held[micros, event_id] = min(action, held.get((micros, event_id), action))
        out = []
        for micros, event_id in sorted(k for k in held if k[0] < mark):
            out += interview.event(micros, event_id, held.pop((micros, event_id)))
        out += interview.passed(mark)
        if held:
            self.waiting.put([(*k, held[k]) for k in sorted(held)])
        elif self.waiting.exists():
            self.waiting.clear()
        if interview.now:
            self.open.update(interview.now)
        elif self.open.exists():
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if interview.now or held:
            seen = interview.now[3] if interview.now else min(held)[0]
            self.handle.registerTimer((seen + self.gap) // 1000 + 1)
        if self.progress and interview.now:
            first, started, ended, _, turns, refused, status = interview.now
            out.append((first, started, ended, turns, refused, status))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["client", "first_event", "started", "ended", "turns", "refused", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r for frame in rows for r in zip(frame["micros"].tolist(), frame["event_id"].tolist(), frame["action"].tolist(), strict=True) if r[0] >= mark]
        yield from self._fold(key, new, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._fold(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def interviews_stream(events: DataFrame, gap_seconds: int = 1800, most_turns: int = 8, late: str = "10 minutes", progress: bool = False) -> DataFrame:
    """interviews() for a stream: a row once an interview has ended, by an event or by a timer in event time.

    With progress, rows of interviews that are open, or completed but not ended, come as well whenever their state is
    looked at; the last row of (client, first_event) counts. Needs a state store that transformWithState supports (RocksDB).
    """
    rows = _events(events).withWatermark("ts", late)
    mode = "Update" if progress else "Append"
    return rows.groupBy("client").transformWithStateInPandas(_Processor(gap_seconds, most_turns, progress), RESULT, mode, "EventTime")
