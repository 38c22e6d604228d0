"""Damaged placeholders, and matching blocks against a plain search."""

import random

import pytest

from evidentia.functions import pii
from evidentia.operators import reinsertion as R
from evidentia.plans import person_queries


def plain_ratio(a, b):
    def met(a, b):
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        return n + met(a[:i], b[:j]) + met(a[i + n :], b[j + n :]) if n else 0

    return 2 * met(a, b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("letters", ["ab", "abcdef", "abcdefghijklmnop"])
def test_ratio(letters):
    pick = random.Random(len(letters))
    for _ in range(150):
        a = [pick.choice(letters) for _ in range(pick.randrange(25))]
        b = a[:] if pick.random() < 0.4 else [pick.choice(letters) for _ in range(pick.randrange(25))]
        for _ in range(pick.randrange(4)):
            if len(b) > 1:
                b.pop(pick.randrange(len(b)))
                b[pick.randrange(len(b))] = pick.choice(letters)
        assert R.match_ratio(a, b) == pytest.approx(plain_ratio(a, b))


def test_long_text():
    a = [str(i % 977) for i in range(20_000)]
    b = [t if i % 400 else "?" for i, t in enumerate(a)]
    assert 0.99 < R.match_ratio(a, b) < 1


def test_damage():
    known = {"[[PERSON_1]]": "Maria [[X]]", "[[PERSON_12]]": "Ede"}
    for text, wanted in (
        ("[[PERSON_1]]s", "Maria [[X]]s"),
        ("[PERSON_1] x", "Maria [[X]] x"),
        ("[[PERSON_12]", "Ede"),
        ("([PERSON_12]])", "(Ede)"),
        ("a [[ person_12 ]] b", "a Ede b"),
        ("[PERSON_2] [1] [a]", "[PERSON_2] [1] [a]"),
    ):
        assert R.restored_text(text, known) == (wanted, [])
    assert R.restored_text("[[PERSON_3]]", known) == ("[[PERSON_3]]", ["[[PERSON_3]]"])


def test_undamaged_text_comes_back_whole():
    for text in ("[[PERSON_1]] wrote to a@b.de", "x⁠y [[[[EMAIL_1]]]] a@b.de", "", "geboren am 1.2.1980, a@b.de"):
        masked, mapping = pii.mask_text(text, year=2024)
        assert R.restored_text(masked, mapping) == (text, [])


def test_rows(spark):
    rows = [(9007199254740993, "[[A_1]] b", [("[[A_1]]", "x")], "x b", 1), (None, None, None, None, 2), (3, "[[A_2]] b c", None, "y b c", 3)]
    frame = spark.createDataFrame([(i, t, dict(m) if m else None, o, n) for i, t, m, o, n in rows], "doc_id long, text string, mapping map<string,string>, original string, restored int")
    got = {r.doc_id: (r.restored, r.unknown, round(r.integrity, 3)) for r in R.reinserted(frame).collect()}
    assert got == {9007199254740993: ("x b", [], 1.0), None: ("", [], 1.0), 3: ("[[A_2]] b c", ["[[A_2]]"], 0.667)}


def test_query_tells_what_was_lost(spark):
    found = person_queries.QUERIES["reinsertion_integrity"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.n_values for r in found)
    for r in found:
        if r.damage == "placeholder lost" and r.n_values:
            assert r.integrity < 1
        elif r.damage != "placeholder lost":
            assert r.integrity == 1.0 and r.n_unknown == 0
