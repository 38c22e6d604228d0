"""Interviews: the table's windows and the stream's timers against a plain fold, event by event."""

import datetime as dt
import random

import pytest

from evidentia.streaming import interviews as I

SCHEMA = "client long, event_id long, ts timestamp, action string, client_name string"
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def some_events(n, seed=3, clients=6):
    pick = random.Random(seed)
    rows, at = [], BASE
    for i in range(n):
        at += dt.timedelta(seconds=pick.choice([0, 60, 600, 1500]), microseconds=pick.randrange(3))
        client = 0 if pick.random() < 0.4 else pick.randrange(clients)  # one client holds a third and more
        rows.append((client, i, at, pick.choice(["turn", None, "turn", "other", "confirm", "restart"]), "x"))
    return rows


def plain(rows, gap, most):
    """Client by client, one event after the other."""
    out, by_client = [], {}
    held = {}
    for client, event_id, at, action, _ in rows:
        if None not in (client, event_id, at):
            action = action if action in ("confirm", "restart") else "turn"
            key = client, at, event_id
            held[key] = min(action, held.get(key, action))
    for client, at, event_id in sorted(held):
        by_client.setdefault(client, []).append((at, event_id, held[client, at, event_id]))
    us = lambda t: round((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))
    for client, events in by_client.items():
        current, last = None, None
        for at, event_id, action in events:
            if current and (at - last > dt.timedelta(seconds=gap)):
                out.append(current)
                current = None
            current = current or {"client": client, "first": event_id, "started": us(at), "ended": us(at), "turns": 0, "refused": 0, "status": "abandoned"}
            last = at
            if action == "restart":
                out.append(current | {"status": "abandoned", "ended": us(at)})
                current = None
            elif current["status"] == "completed":
                current["refused"] += 1
            else:
                current["turns"] += 1
                current["ended"] = us(at)
                if action == "confirm" or current["turns"] == most:
                    current["status"] = "completed"
        if current:
            out.append(current)
    return sorted(tuple(o.values()) for o in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_table(spark, seed):
    rows = some_events(400, seed)
    rows += rows[:20] + [(None, 1, BASE, "turn", ""), (1, None, BASE, "turn", ""), (1, 7, None, "turn", "")]
    got = sorted(tuple(r) for r in I.interviews(spark.createDataFrame(rows, SCHEMA), 1800, 3).collect())
    assert got == plain(rows, 1800, 3)
    assert {r[-1] for r in got} == {"completed", "abandoned"} and any(r[5] for r in got)


def test_no_events(spark):
    assert I.interviews(spark.createDataFrame([], SCHEMA)).collect() == []


def run(spark, tmp_path, parts, progress=False, **options):
    """The stream over files that come one a batch, stopped after each; the last one is far ahead and moves the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    (tmp_path / "in").mkdir()
    seen = []
    for i, part in enumerate([*parts, [(99, 999_999, BASE + dt.timedelta(days=900), "turn", "")]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        out = I.interviews_stream(stream, progress=progress, **options).writeStream.foreachBatch(lambda rows, batch: seen.extend(tuple(r) for r in rows.collect()))
        query = out.outputMode("update" if progress else "append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [r for r in seen if r[0] != 99]


def test_stream_equals_table_across_restarts(spark, tmp_path):
    rows = some_events(240, 5)
    mixed = rows[:]
    for i in range(0, len(mixed) - 1, 2):  # out of order, within the watermark
        mixed[i], mixed[i + 1] = mixed[i + 1], mixed[i]
    parts = [mixed[:90], mixed[90:91], mixed[91:] + mixed[200:210]]
    assert sorted(run(spark, tmp_path, parts, gap_seconds=1800, most_turns=3, late="1 hour")) == plain(rows, 1800, 3)


def test_one_event_ends_by_timer_and_late_ones_are_left_out(spark, tmp_path):
    first, other = (1, 1, BASE, "turn", ""), (2, 2, BASE + dt.timedelta(hours=9), "turn", "")
    late = (1, 3, BASE + dt.timedelta(minutes=1), "turn", "")
    got = run(spark, tmp_path, [[first], [other], [late]], gap_seconds=1800, most_turns=3, late="1 hour")
    assert sorted((r[0], r[1], r[4], r[6]) for r in got) == [(1, 1, 1, "abandoned"), (2, 2, 1, "abandoned")]


def test_progress_tells_open_and_completed(spark, tmp_path):
    minute = lambda m: BASE + dt.timedelta(minutes=m)
    parts = [[(1, 1, minute(0), "turn", "")], [(2, 9, minute(5), "turn", "")], [(1, 2, minute(6), "confirm", "")], [(2, 10, minute(20), "turn", "")], [(1, 3, minute(21), "turn", "")]]
    got = run(spark, tmp_path, parts, progress=True, gap_seconds=1800, most_turns=3, late="1 minute")
    assert list(dict.fromkeys((r[4], r[5], r[6]) for r in got if r[0] == 1)) == [(1, 0, "open"), (2, 0, "completed"), (2, 1, "completed")]


def test_steps():
    i = I.Interview(10, 2)
    assert i.event(0, 1, "turn") == [] and i.now[-1] == "open"
    assert i.event(5, 2, "turn") == [] and i.now[-1] == "completed"
    assert i.event(9, 3, "confirm") == [] and i.now[4:] == (2, 1, "completed")
    assert i.passed(19) == [] and i.passed(20) == [(1, 0, 5, 2, 1, "completed")] and i.now is None
    assert i.event(30, 4, "restart") == [(4, 30, 30, 0, 0, "abandoned")]
