"""Names of a gazetteer in texts, with their inflections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import batches
from evidentia.functions.automaton import Automaton

#: Endings that a name of three letters and more takes.
ENDINGS = ("s", "es", "ns")
#: Letters of all forms that are sent to every task; a larger gazetteer is joined with the words of the texts.
MOST_LETTERS = 4_000_000
#: Frequent given names; a gazetteer of one's own takes their place.
GIVEN_NAMES = (
    "Anna Andreas Angelika Anja Bernd Brigitte Christian Christine Claudia Daniel Elisabeth Emma Erika Frank Gabriele Gerhard Hans Heike Helga Ingrid Jan Jens Johannes Jonas Jürgen Karin Karl Klaus Lena "
    "Leon Lukas Maria Marie Markus Martin Michael Monika Nicole Oliver Paul Peter Petra Renate Sabine Sandra Simone Sophie Stefan Stefanie Susanne Thomas Ursula Uwe Werner Wolfgang Özlem"
).split()
#: Words that are places as well, and so no names.
PLACES = "Berlin Bremen Essen Halle Hamburg Jena Kassel Köln Leipzig München Paderborn Roman Sachsen Bayern Hessen".split()
_BREAKS = ".!?"


def forms(names: Iterable[str], places: Iterable[str] = PLACES) -> dict[str, str]:
    """Form -> name for every capitalised name and its inflections; what is a name already is no inflection."""
    kept = {n: n for n in sorted(filter(None, names), reverse=True)}  # of names that share a form, the least stays
    gone = {p.lower() for p in places}
    out = {name + e: name for name in kept if len(name) >= 3 for e in ENDINGS} | kept
    return {form: name for form, name in out.items() if form.lower() not in gone}


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def spans_in(text: str, automaton: Automaton, known: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of whole words, as they end; a plain name that opens a sentence may be another word."""
    for start, end in automaton.find(text):
        if (start and _word(text[start - 1])) or (end < len(text) and _word(text[end])):
            continue
        form = text[start:end]
        if form == known[form] and (before := text[max(0, start - 3) : start].strip(" \t\n")) and before[-1] in _BREAKS:
            continue
        yield start, end, known[form]


def finder(known: dict[str, str]) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    """spans_in() for one set of forms: forms of one word are looked up word by word, the automaton finds only the rest."""
    words = {form: name for form, name in known.items() if re.fullmatch(r"\w+", form)}
    rest = {form: name for form, name in known.items() if form not in words}
    # from a form's first letter to the end of the word; within a word that begins otherwise it is no form
    start = re.compile(f"[{''.join(map(re.escape, sorted({form[0] for form in words})))}]\\w*" if words else "(?!)")
    automaton = Automaton(rest)

    def whole_words(text: str) -> Iterator[tuple[int, int, str]]:
        for m in start.finditer(text):
            name = words.get(m[0])
            if name is None or ((at := m.start()) and _word(text[at - 1])):
                continue
            if m[0] == name and (before := text[max(0, at - 3) : at].strip(" \t\n")) and before[-1] in _BREAKS:
                continue
            yield at, m.end(), name

    def both(text: str) -> Iterator[tuple[int, int, str]]:
        yield from sorted([*whole_words(text), *spans_in(text, automaton, rest)], key=lambda s: (s[1], s[0]))

    return both if rest else whole_words


def name_spans(docs: DataFrame, gazetteer: DataFrame, places: Iterable[str] = PLACES) -> DataFrame:
    """(doc_id, start, end, name) for every place of a gazetteer's names (column ``name``) in the texts.

    start counts code points from 0, end is exclusive. Forms are whole words; a plain name right after a full stop,
    exclamation or question mark is left out, an inflected one is not. The names go to every task as one automaton
    while their forms have MOST_LETTERS at most; more are joined with the words of the texts (names of one word
    alone, as the texts are cut into words). Null names and texts give nothing; repeated rows of docs repeat.
    """
    sizes = gazetteer.agg(F.coalesce(F.sum(F.length("name") + 3), F.lit(0)) * (1 + len(ENDINGS))).first()[0]
    if sizes > MOST_LETTERS:
        return _joined(docs, gazetteer, places)
    known = forms((r.name for r in gazetteer.where("name <> ''").distinct().collect()), places)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())])

    def rows(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder(known)
        for batch in read:
            yield from batches.row_batches(batch, found, schema)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, start int, end int, name string")


def _joined(docs: DataFrame, gazetteer: DataFrame, places: Iterable[str]) -> DataFrame:
    """The same by a join of the texts' words with names times endings."""
    names = gazetteer.where("name <> ''").select("name").distinct()
    inflected = names.where(F.length("name") >= 3).select(F.explode(F.array(*[F.concat("name", F.lit(e)) for e in ENDINGS])).alias("form"), "name").join(names.select(F.col("name").alias("form")), "form", "left_anti")
    every = names.select(F.col("name").alias("form"), "name").unionByName(inflected).where(~F.lower("form").isin([p.lower() for p in places]))
    every = every.groupBy("form").agg(F.min("name").alias("name"))
    word = r"[\p{L}\p{N}_]+"
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("words"), F.split("text", word).alias("rest"))
    # a word begins after all that stands before it: the lengths of words and of what parts them
    lengths = F.transform("words", lambda w, i: F.struct(w.alias("form"), (F.length(F.element_at("rest", i + 1)) + F.when(i > 0, F.length(F.element_at("words", F.greatest(i, F.lit(1))))).otherwise(0)).alias("step"), F.substring(F.concat(F.lit("x"), F.element_at("rest", i + 1)), -3, 3).alias("gap")))
    placed = cut.select("doc_id", "row", F.posexplode(lengths).alias("i", "w"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("doc_id", "w.form", "w.gap", F.sum("w.step").over(so_far).cast("int").alias("start"))
    found = placed.join(every, "form")
    opens = (F.col("form") == F.col("name")) & F.rtrim(F.translate("gap", "\t\n", "  ")).rlike(r"[.!?]$")
    return found.where(~opens).select("doc_id", "start", (F.col("start") + F.length("form")).alias("end"), "name")
