"""Dates as people write them, names of days, labels, areas and verdicts in words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of weekdays, areas and their other names in the order they are tried, and the phrases of verdicts.
WEEKDAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
AREAS = ("sozialrecht", "erbrecht", "schenkungsrecht", "familienrecht")
SYNONYMS = (
    ("social", "sozialrecht"), ("sozial", "sozialrecht"), ("soziales", "sozialrecht"), ("arbeitslosengeld ii", "sozialrecht"), ("erbschaft", "erbrecht"), ("erben", "erbrecht"),
    ("nachfolge", "erbrecht"), ("schenken", "schenkungsrecht"), ("schenkung", "schenkungsrecht"), ("scheidungsrecht", "familienrecht"), ("trennung", "familienrecht"),
)
VERDICTS = (
    ("teilweise_rechtswidrig", ("teilweise rechtswidrig", "teils rechtswidrig", "teilweise rechtsfehlerhaft")),
    ("ueberwiegend_rechtmaessig", ("überwiegend rechtmäßig", "im wesentlichen korrekt", "weist jedoch keine durchgreifenden fehler")),
    ("rechtswidrig", ("rechtswidrig", "nicht rechtmäßig", "unzulässig")),
    ("kein_verwaltungsakt", ("kein verwaltungsakt", "nicht verwaltungsakt", "kein va")),
)


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(day) + 1)


def tolerant_date(value: Column) -> Column:
    """A date written as yyyy-mm-dd or dd.mm.yyyy; null for anything else."""
    iso = F.when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(F.rlike(value, F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.try_to_date(value, "d.M.yyyy")))


def area_of(value: Column) -> Column:
    """The closed list's name for an area: itself, by another name, or by the first other name that it contains."""
    low = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for name, area in reversed(SYNONYMS):
        out = F.when(F.contains(low, F.lit(name)), F.lit(area)).otherwise(out)
    for name, area in reversed(SYNONYMS):
        out = F.when(low == name, F.lit(area)).otherwise(out)
    return F.when(low.isin(*AREAS), low).otherwise(out)


def verdict_of(text: Column) -> Column:
    """The first verdict with a phrase in the text, whatever the case of its letters."""
    out, low = F.lit(None).cast("string"), F.lower(text)
    for name, phrases in reversed(VERDICTS):
        has = F.contains(low, F.lit(phrases[0]))
        for p in phrases[1:]:
            has = has | F.contains(low, F.lit(p))
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def euros(value: Column) -> Column:
    return F.concat(value.cast("decimal(18,2)").cast("string"), F.lit(" EUR"))


def humanised(label: Column, known: dict[str, str]) -> Column:
    """A label's own name, else its words with capitals."""
    out = F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))
    for k, v in known.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def _plain_letters() -> tuple[str, str]:
    """Letters of one base letter and combining marks, up to Latin Extended Additional, and their base letters."""
    found = {}
    for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(p)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(p):
            found[chr(p)] = base
    return "".join(found), "".join(found.values())


def egress_form(text: Column) -> Column:
    """Text as leaks are looked for: no marks over letters, lower case, ß as ss. Marks that stand alone go as well."""
    letters, plain = _plain_letters()
    bare = F.regexp_replace(F.translate(text, letters, plain), "\\p{Mn}", "")
    return F.replace(F.lower(bare), F.lit("ß"), F.lit("ss"))
