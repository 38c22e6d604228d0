"""Names, spans and masking against plain loops."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.functions import pii
from evidentia.functions.automaton import Automaton
from evidentia.operators import names, spans


@given(st.lists(st.text("abc", max_size=5), max_size=12), st.text("abcd", max_size=60))
@settings(max_examples=400, deadline=None)
def test_automaton_finds_every_place(patterns, text):
    want = sorted((i, i + len(p)) for p in set(patterns) if p for i in range(len(text)) if text.startswith(p, i))
    assert sorted(Automaton(patterns).find(text)) == want


NAMES = ["Jan", "Jans", "Anna", "Anna Maria", "Ines", "Jo", "Özlem", "Köln", "Marie"]
TEXTS = [
    "Annas Kind und Anna. Anna kam! Jan", "Annahaus xAnna Anna_1 Anna1 ANNA anna Anna-Lena Anna", "Maries Jans Janns Inesns Joes Jos Jo", "Anna Maria und Anna Marias, Özlems Köln Kölns", "?Anna ?Annas .\n\tAnna !  Anna", "", None, "Anna",
]


def brute_names(text):
    out = []
    for m in re.finditer(r"(?=(\w[\w ]*))", text or ""):
        if m.start() and re.match(r"\w", text[m.start() - 1]):
            continue
        for name in NAMES:
            for ending in ("", *names.ENDINGS):
                form, end = name + ending, m.start() + len(name + ending)
                if not text.startswith(form, m.start()) or re.match(r"\w", text[end : end + 1]) or form == "Köln":
                    continue
                if ending and (len(name) < 3 or form in NAMES):
                    continue
                before = text[max(0, m.start() - 3) : m.start()].strip(" \t\n")
                if ending or not before or before[-1] not in ".!?":
                    out.append((m.start(), end, name))
    return out


def test_names(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, "Anna")], "doc_id long, text string")
    gazetteer = spark.createDataFrame([(n,) for n in [*NAMES, "Anna", "", None]], "name string")
    want = sorted(((i, *s) for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (None, "Anna")] for s in brute_names(t)), key=repr)
    assert sorted(map(tuple, names.name_spans(docs, gazetteer).collect()), key=repr) == want
    monkeypatch.setattr(names, "MOST_LETTERS", 0)  # a gazetteer that no task may hold: words alone
    assert sorted(map(tuple, names.name_spans(docs, gazetteer).collect()), key=repr) == [w for w in want if " " not in w[-1]]
    assert names.name_spans(docs, gazetteer.limit(0)).isEmpty() and names.name_spans(docs.limit(0), gazetteer).isEmpty()


def test_spans_without_overlaps(spark):
    rng = random.Random(3)
    rows = [(k, s, s + rng.randint(0, 9), rng.randint(0, 4), rng.choice("xy")) for k in (1, 2, None) for s in (rng.randint(0, 200) for _ in range(120))]
    want = []
    for key in (1, 2, None):
        kept = []
        for row in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1] - r[2], r[1], r[2], r[4])):
            if not any(k[1] < row[2] and row[1] < k[2] for k in kept):
                kept.append(row)
        want += kept
    got = spans.without_overlaps(spark.createDataFrame(rows, "doc_id long, start int, end int, rank int, kind string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


PERSONS = names.forms(names.GIVEN_NAMES)


def finder(text):
    return ((a, b) for a, b, _ in names.spans_in(text, Automaton(PERSONS), PERSONS))


@pytest.mark.parametrize(
    "text, masked",
    [
        ("Frau Meier, geboren am 03.04.1980, wohnt Lindenstraße 12a.", "[[NAME_1]], geboren am [[GEBURTSDATUM_1]] (ca. 46 Jahre), wohnt [[ADRESSE_1]]."),
        ("geb. 3. 4. 80 (46 Jahre alt)", "geb. [[GEBURTSDATUM_1]] (46 Jahre alt)"),
        ("Am Alten Weg 3 - 5 und Am Alten Weg 3 - 5", "[[ADRESSE_1]] und [[ADRESSE_1]]"),
        ("Amtsgericht Platz 3, Termin am 03.04.2024", "Amtsgericht Platz 3, Termin am 03.04.2024"),
        ("der Meier wohnhaft in Ulm; Schulz, geboren am Rhein", "der [[PERSON_1]] wohnhaft in Ulm; [[PERSON_2]], geboren am Rhein"),
        ("bei Peters und Karin", "bei [[PERSON_1]] und [[PERSON_2]]"),
    ],
)
def test_persons_are_masked(text, masked):
    out, mapping = pii.mask_text(text, finder, 2026)
    assert out.replace("⁠", "") == masked and pii.unmask_text(out, mapping) == text


@given(st.lists(st.sampled_from(["[", "[[", "⁠", "]]", "[[EMAIL_1]]", "a@b.org", " ", "geb. 1.2.1990", " (ca. 36 Jahre)", "Anna", "Frau Kurz", "X", "Ring 3", "⁠ (ca. 36 Jahre)⁠"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_unmasking_undoes_masking(text):
    out, mapping = pii.mask_text(text, finder, 2026)
    assert pii.unmask_text(out, mapping) == text
