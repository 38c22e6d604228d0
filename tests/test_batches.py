"""Large batches are worked off in slices: no worker holds the Python objects of a whole one."""

import random
import re

import pyarrow as pa
import pytest

from evidentia.functions import pii
from evidentia.functions.automaton import Automaton
from evidentia.operators import names, reinsertion
from evidentia.plans import person_queries


class Given:
    """Stands for a table: takes what would go to the workers and gives it one batch."""

    def __init__(self, spark, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)
        self.schema = spark.createDataFrame([], "doc_id long, text string, mapping map<string,string>, original string").schema

    def select(self, *_):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return list(f(iter([self.batch])))


TEXT = "Frau Meier wohnhaft in Ulm schrieb an Anna, Annas Post kam. " * 20_000


def test_batches_leave_in_parts(spark):
    docs = Given(spark, doc_id=[1, None, 3, 4], text=[TEXT, TEXT, None, TEXT])
    gazetteer = spark.createDataFrame([("Anna",)], "name string")
    for out in (pii.masked(docs, ["Anna"]), pii.detected(docs, ["Anna"]), names.name_spans(docs, gazetteer)):
        assert len(out) >= 3 and max(b.num_rows for b in out) <= 50_000
    found = [r for b in names.name_spans(docs, gazetteer) for r in b.to_pylist()]
    assert len(found) == 3 * 40_000 and [r["doc_id"] for r in found[::40_000]] == [1, None, 4]
    rows = Given(spark, doc_id=[1, 2, 3], text=[TEXT, None, TEXT], mapping=pa.array([[], None, []], pa.map_(pa.string(), pa.string())), original=[TEXT, "a", TEXT])
    out = reinsertion.reinserted(rows)
    assert len(out) >= 2 and [(r["doc_id"], r["integrity"]) for b in out for r in b.to_pylist()] == [(1, 1.0), (2, 0.0), (3, 1.0)]


PIECES = (
    "Am |An der |Auf dem |Zum |Weg| weg|Straße|straße|str.|Str.|ufer|Ring| |  |-| - |1|12|12345|3a| h|0|00|49|+49|(0)|/|//|.|..|@|a|b.de|x-y|DE|Haus|Gericht|A|Ä|ß|_|é|\n|\t|geb.|geboren am|*|1.2.80|12. 3. 1990"
    "|Frau |Dr. |Meier|A-|@a.b|a@b.org|=|{|99|65170839J008|86095742719|12345/0012345|DE12345678901234567890|Karl| wohnhaft in"
).split("|")


@pytest.mark.parametrize("seed", range(4))
def test_detectors_find_what_their_patterns_match(seed):
    pick = random.Random(seed)
    for _ in range(1500):
        text = pick.choice(("", " ")).join(pick.choices(PIECES, k=pick.randrange(40)))
        for kind, pattern in pii.PATTERNS.items():
            want = [m.span(m.re.groups) for m in re.finditer(pattern, text) if kind != "ADRESSE" or not re.search(pii.AUTHORITY, m[0])]
            assert list(pii.found_in(text, kind)) == want, (kind, text)


def test_names_of_one_and_of_several_words():
    known = names.forms(["Jan", "Anna", "Anna Maria", "Özlem", "-x", "É"])
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choices(["Jan", "Anna", " Maria", "Özlem", "s", "-x", "É", " ", ". ", "x", "_", "1"], k=12))
        assert list(names.finder(known)(text)) == list(names.spans_in(text, Automaton(known), known)), text


def test_long_texts_are_searched_in_time():
    """No search from every character on: addresses, mail and names of a megabyte without a match."""
    import time

    for text in ("A-" * 100_000, "a." * 100_000 + " x", "Haus " * 100_000):
        began = time.process_time()
        assert not any(list(pii.found_in(text, kind)) for kind in ("EMAIL", "ADRESSE"))
        assert time.process_time() - began < 2


def test_leaks(spark):
    rows = spark.createDataFrame([("abc", {"k": "BC"}), ("abc", {"k": "x"}), ("abc", {"k": "b"}), ("abc", {}), (None, {"k": "bc"}), ("abc", None)], "m string, v map<string,string>")
    assert [r[0] for r in rows.select(pii.leaks(rows.m, rows.v)).collect()] == [True, False, False, False, None, None]


def test_query_is_as_before(spark):
    rows = person_queries.QUERIES["masked_personal_data"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_left == 0 and not r.leaks for r in rows)
