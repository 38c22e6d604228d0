"""Merge patches replayed, against a plain fold; and which stages run again."""

import copy
import datetime as dt
import json
import random

from evidentia.operators import edits as E
from evidentia.operators import stages

BASE = dt.datetime(2024, 1, 1)


def merged(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def told(value, path=()):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in told(v, (*path, k))]
    return [] if value is None else [(path, json.dumps(value, ensure_ascii=False, separators=(",", ":")))]


def some_patch(pick, depth=0):
    if depth == 3 or pick.random() < (0.05 if depth == 0 else 0.5):
        return pick.choice([None, None, 1, "ä", [1, {"x": None}], 2.5, {}, ""])
    return {pick.choice(["a", "b", "", "a.b"]): some_patch(pick, depth + 1) for _ in range(pick.randrange(3))}


def test_states_at_instants(spark):
    pick = random.Random(4)
    rows = [(pick.choice([0, 0, 1, 2, None]), BASE + dt.timedelta(hours=pick.randrange(40)), i, json.dumps(some_patch(pick)), "x") for i in range(300)]
    rows += rows[:9] + [(1, None, 5, "{}", ""), (1, BASE, 999, None, ""), (1, BASE, 998, "no json", "")]
    instants = [BASE + dt.timedelta(hours=h) for h in (0, 7, 21, 99)]
    frame = spark.createDataFrame(rows, "key long, at timestamp_ntz, number long, patch string, value string")
    got = sorted(((r.key, r.instant, tuple(r.path), r.value) for r in E.states(frame, instants).collect()), key=repr)
    expected = []
    for instant in instants:
        held = {}
        for key, at, _, patch, _ in sorted((r for r in {r[:4]: r for r in rows}.values() if r[1] is not None), key=lambda r: (r[1], r[2])):
            if at <= instant and patch not in (None, "no json"):
                held[key] = merged(copy.deepcopy(held.get(key)), json.loads(patch))
        expected += [(key, instant, path, value) for key, state in held.items() for path, value in told(state)]
    assert len(expected) > 20 and got == sorted(expected, key=repr)


def test_edit_to_null_and_nothing(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key long, at timestamp_ntz, number long, patch string")
    rows = [(1, BASE, 1, '{"s":{"t":"x"},"u":1}'), (1, BASE, 2, '{"s":null}')]
    assert [(r.path, r.value) for r in E.states(frame(rows), [BASE]).collect()] == [(["u"], "1")]
    assert E.states(frame([]), [BASE]).collect() == []
    (kept,) = E.trail(frame([*rows, (1, None, 3, "{}")]), "key", "at", "number", 2).collect()
    assert kept.n_edits == 3 and [e.number for e in kept.edits] == [1, 2]


def test_stages_run_again(spark):
    rows = [(1, "classification"), (1, "generation"), (2, "verification"), (2, "verification"), (3, "unknown"), (None, "x"), (4, None)]
    got = sorted(tuple(r) for r in stages.to_rerun(spark.createDataFrame(rows, "case_id long, stage string")).collect())
    assert got == sorted(
        [(1, s, n, False) for s, n in (("classification", 0), ("generation", 0), ("retrieval", 1), ("construction", 2), ("verification", 3), ("adversarial_review", 4), ("calculation_check", 5))]
        + [(2, s, n, False) for s, n in (("verification", 0), ("adversarial_review", 1), ("calculation_check", 2))]
        + [(3, "unknown", 0, False)]
    )


def test_cycles_are_told(spark):
    feeds = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), ("e", "a"), (None, "a")], "stage string, later string")
    got = {(r.stage, r.later): (r.steps, r.cyclic) for r in stages.closure(spark, feeds).collect()}
    assert got[("a", "a")] == (3, True) and got[("b", "d")] == (2, True) and got[("e", "d")] == (4, False)
    assert len(got) == 16 and ("d", "a") not in got
