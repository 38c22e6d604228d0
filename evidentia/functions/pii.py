"""Personal data: detectors, reversible masking with numbered placeholders, and leakage checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import batches
from evidentia.operators import names as gazetteer

_BLANK = "[ \\t\\n]?"  # single blanks that groups of digits may be printed with


def _digits(n: int) -> str:
    """n digits in groups of any size."""
    return f"(?:{_BLANK}[0-9]){{{n}}}"


_ATOM = "[A-Za-z0-9!#$%&*+/=?^_{|}~-]+"  # of an address' local part
#: Detectors in the order they apply, from the public formats: what an earlier one takes, a later one does not see.
PATTERNS = {
    # number of a household: five digits, one or two slashes, seven digits
    "BG_NUMMER": f"\\b[0-9]{{5}}{_BLANK}//?{_digits(7)}\\b",
    # account number: country, two check digits and eighteen more, printed in groups
    "IBAN": f"\\bDE{_digits(20)}\\b",
    # pension insurance: area, day of birth (raised by 50 at most once), initial, serial number and check digit
    "SV_NUMMER": f"\\b[0-9]{{2}}{_BLANK}[0-8][0-9]{_BLANK}[01][0-9]{_BLANK}[0-9]{{2}}{_BLANK}[A-Z]{_digits(3)}\\b",
    # dotted atoms, then labels up to a domain of letters
    "EMAIL": f"\\b{_ATOM}(?:\\.{_ATOM})*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}\\b",
    # country or trunk prefix, area code without a zero, subscriber in groups
    "TELEFON": "(?:(?:\\+|\\b00)49[ /-]?(?:\\(0\\)[ /-]?)?|\\b0)[1-9][0-9]{1,4}\\)?(?: ?[ /-]?[0-9]){3,10}\\b",
    # eleven digits, the first no zero, printed as two and three times three
    "STEUER_ID": f"\\b[1-9][0-9](?:{_BLANK}[0-9]{{3}}){{3}}\\b",
    # a street's name ends in one of these words, then comes the number of a house or of two
    "ADRESSE": r"(?:\b(?:Am|An der|Auf dem|Im|In der|Zum|Zur) )?\b[A-ZÄÖÜ][A-Za-zäöüß-]*(?: [A-ZÄÖÜ][a-zäöüß-]+)? ?(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Aa]llee|[Pp]latz|[Gg]asse|[Ww]eg|[Rr]ing|[Dd]amm|[Uu]fer) ?[0-9]{1,4}(?: ?- ?[0-9]{1,4}| ?[a-h]\b)?",
    # the date alone, where words before it say that it is one of birth
    "GEBURTSDATUM": r"(?:[Gg]eboren am|[Gg]eb\.|[Gg]eburtsdatum:?|\*) ?([0-9]{1,2}\. ?[0-9]{1,2}\. ?(?:[0-9]{4}|[0-9]{2}))",
    "NAME": r"(?:Herrn?|Frau|Fr\.|Hr\.)\s+(?:(?:Dr|Prof)\.\s+)*[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)?",
    # the name alone, before words that only a person's name stands before
    "PERSON": r"([A-ZÄÖÜ][a-zäöüß]+(?: [A-ZÄÖÜ][a-zäöüß]+)?)(?: wohnhaft in|, geboren am)",
}
#: What looks like an address but names an authority is none.
AUTHORITY = "(?i)gericht|jobcenter|agentur|behörde|ministerium|rathaus"
PLACEHOLDER = r"\[\[[A-Z_]+_[0-9]+\]\]"


def counted(text: Column, kind: str) -> Column:
    """Places that a detector finds in the text, taken by itself."""
    return F.regexp_count(text, F.lit(PATTERNS[kind]))


_JOINER = "\u2060"
_AGE = re.compile("\\(?[ ]?(?:ca\\. )?[0-9]{1,3} (?:Jahre|J\\.)")
_ADDED = f"{_JOINER} \\(ca\\. -?[0-9]+ Jahre\\){_JOINER}"


#: The same patterns for a search that skips to a first character: \b comes behind it, as a look back.
_FAST = {
    kind: re.compile(p)
    for kind, p in (PATTERNS | {
        "BG_NUMMER": f"[0-9](?<=\\b[0-9])[0-9]{{4}}{_BLANK}//?{_digits(7)}\\b",
        "IBAN": f"DE(?<=\\bDE){_digits(20)}\\b",
        "SV_NUMMER": f"[0-9](?<=\\b[0-9])[0-9]{_BLANK}[0-8][0-9]{_BLANK}[01][0-9]{_BLANK}[0-9]{{2}}{_BLANK}[A-Z]{_digits(3)}\\b",
        "TELEFON": "[+0](?:(?:(?<=\\+)|(?<=\\b0)0)49[ /-]?(?:\\(0\\)[ /-]?)?|(?<=\\b0))[1-9][0-9]{1,4}\\)?(?: ?[ /-]?[0-9]){3,10}\\b",
        "STEUER_ID": f"[1-9](?<=\\b[1-9])[0-9](?:{_BLANK}[0-9]{{3}}){{3}}\\b",
        "GEBURTSDATUM": r"[Gg*](?:(?<=[Gg])eb(?:oren am|\.|urtsdatum:?)|(?<=\*)) ?([0-9]{1,2}\. ?[0-9]{1,2}\. ?(?:[0-9]{4}|[0-9]{2}))",
    }).items()
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!#$%&*+/=?^_{|}~-.")
_DOMAIN = re.compile(PATTERNS["EMAIL"].partition("@")[2])
_NUMBER = re.compile("[0-9]+")
_STREETS = tuple(f"{c}{w[1:]}" for w in ("straße", "strasse", "str.", "allee", "platz", "gasse", "weg", "ring", "damm", "ufer") for c in (w[0], w[0].upper()))


def _emails(text: str) -> Iterator[re.Match]:
    """Matches around every @ that a domain follows; what stands before it reaches back to a character of no address."""
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            # one character more, for the bound behind it
            if m := _FAST["EMAIL"].search(text, start, domain.end() + 1):
                yield m
                done = m.end()
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[re.Match]:
    """Matches around every number that a street's last word stands before; at most four blanks come before that word."""
    done = before = 0
    for number in _NUMBER.finditer(text):
        at = number.start()
        word = at - (at > 0 and text[at - 1] == " ")
        if at >= done and text.endswith(_STREETS, max(before, word - 7), word):
            start = word - 3
            for _ in range(5):
                start = text.rfind(" ", before, max(before, start))
                if start < 0:
                    break
            if (m := _FAST["ADRESSE"].search(text, max(start + 1, before, done), at + 12)) and m.start() < at:
                yield m
                done = m.end()
        before = number.end()


def found_in(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values that a detector finds, from left to right."""
    for m in _emails(text) if kind == "EMAIL" else _addresses(text) if kind == "ADRESSE" else _FAST[kind].finditer(text):
        if kind != "ADRESSE" or not re.search(AUTHORITY, m[0]):
            yield m.span(m.re.groups)


def age(date: str, year: int) -> int:
    """Years from the date's year to the given one; of two-digit years, the last that lies before it."""
    born = int(date.rpartition(".")[2])
    return year - born if born >= 100 else (year - born) % 100


def mask_text(text: str, names: Callable[[str], Iterable[tuple[int, int]]] | None = None, year: int | None = None) -> tuple[str, dict[str, str]]:
    """Masked text and placeholder -> value. Equal values of a kind share one placeholder, numbered by first place.

    names finds further persons' names, as (start, end); they get placeholders like other persons. With a year, an
    age that is not stated after a date of birth is added to its placeholder. unmask_text() undoes all of it.
    """
    values: dict[tuple[str, str], str] = {}
    # what looks like a placeholder already is kept apart by a word joiner, which unmasking takes out again
    out = re.sub(r"\[(?=\[)", f"[{_JOINER}", text.replace(_JOINER, _JOINER * 2))

    def named(kind: str, value: str) -> str:
        if (kind, value) not in values:
            values[kind, value] = f"[[{kind}_{1 + sum(k == kind for k, _ in values)}]]"
        return values[kind, value]

    def replaced(part: str, kind: str, spans: Iterable[tuple[int, int]]) -> str:
        pieces, at = [], 0
        for start, end in spans:
            if start < at:
                continue
            pieces += [part[at:start], named(kind, part[start:end])]
            if kind == "GEBURTSDATUM" and year is not None and not _AGE.search(part[end : end + 60]):
                pieces.append(f"{_JOINER} (ca. {age(part[start:end], year)} Jahre){_JOINER}")
            at = end
        return "".join((*pieces, part[at:]))

    for kind in PATTERNS:
        parts = re.split(f"({PLACEHOLDER})", out)
        out = "".join(p if i % 2 else replaced(p, kind, found_in(p, kind)) for i, p in enumerate(parts))
    if names:
        out = replaced(out, "PERSON", names(out))
    return out, {v: value for (_, value), v in values.items()}


def unmask_text(text: str, mapping: dict[str, str]) -> str:
    out = re.sub(f"({PLACEHOLDER})({_ADDED})?", lambda m: mapping[m[1]] if m[1] in mapping else m[0], text)
    return re.sub(f"{_JOINER}({_JOINER})|(?<=\\[){_JOINER}(?=\\[)", lambda m: m[1] or "", out)


def masked(docs: DataFrame, names: Iterable[str] = (), year: int | None = None) -> DataFrame:
    """(doc_id, masked, mapping, restored): placeholders are numbered per document, which needs its state.

    names is a gazetteer of given names, of a size to send to every task. Null texts count as empty; null ids stay.
    """
    known = gazetteer.forms(names)

    schema = pa.schema([("doc_id", pa.int64()), ("masked", pa.string()), ("mapping", pa.map_(pa.string(), pa.string())), ("restored", pa.string())])

    def rows(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = gazetteer.finder(known)
        persons = lambda text: ((a, b) for a, b, _ in spans(text))
        for batch in read:
            for part in batches.slices(batch):
                found = [mask_text(t or "", persons if known else None, year) for t in part.column("text").to_pylist()]
                columns = ([m for m, _ in found], [list(v.items()) for _, v in found], [unmask_text(m, v) for m, v in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, masked string, mapping map<string,string>, restored string")


def detected(docs: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """(doc_id, start, end, rank, kind) of what each detector finds in whole texts by itself; they may overlap.

    rank is the detector's place in the order in which they apply; names of the gazetteer come last.
    """
    known = gazetteer.forms(names)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int32()), ("kind", pa.string())])

    def rows(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = gazetteer.finder(known)

        def found(text: str) -> Iterator[tuple]:
            for rank, kind in enumerate(PATTERNS):
                yield from ((a, b, rank, kind) for a, b in found_in(text, kind))
            yield from ((a, b, len(PATTERNS), "PERSON") for a, b, _ in spans(text))

        for batch in read:
            yield from batches.row_batches(batch, found, schema)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, start int, end int, rank int, kind string")


def leaks(masked: Column, mapping: Column) -> Column:
    """Whether a masked value of two characters or more still stands in the text."""
    held = lambda text: F.exists(F.map_values(mapping), lambda v: (F.length(v) >= 2) & F.contains(text, F.lower(v)))
    return F.exists(F.array(F.lower(masked)), held)  # a text of its own, else it is lower-cased again for every value
