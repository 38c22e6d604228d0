"""Queries on personal data: names of a gazetteer, addresses and dates of birth, spans without overlaps, masking.

The documents hold no German personal data but numbers, so each is followed by a letter's lines with values dealt
by its id; the detectors read the whole of it.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import pii
from evidentia.operators import names, reinsertion, spans
from evidentia.sources.tables import table, values


def _pick(key: str, of) -> str:
    """SQL of both engines: the value that a number deals."""
    return f"CASE ({key}) % {len(of)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(of)) + " END"


_NAME = [_pick(f"coalesce(doc_id, 0) * {a} + {b}", names.GIVEN_NAMES) for a, b in ((1, 0), (7, 3), (5, 11), (3, 29))]
_END = _pick("coalesce(doc_id, 0)", ("s", "es", "ns", "", "n"))
_STREET = _pick("coalesce(doc_id, 0)", ("Lindenstraße", "Am Alten Ring", "Goethestr.", "Amtsgericht Platz", "Zum Rosen Weg", "Berliner Allee", "Rathaus Gasse"))
_BORN = _pick("coalesce(doc_id, 0)", ("geboren am", "geb.", "Geburtsdatum:", "*", "gestellt am"))
_DATE = "((coalesce(doc_id, 0) % 28) + 1) || '.' || ((coalesce(doc_id, 0) % 12) + 1) || '.' || (1950 + coalesce(doc_id, 0) % 60)"
#: The document, then lines that hold names as they stand, inflected, in other words, at the start of sentences.
LETTER = (
    f"coalesce(text, '') || '\nZeuge war ' || {_NAME[0]} || ', dann ' || {_NAME[1]} || {_END} || ' Kind. ' || {_NAME[2]} || ' kam! ' || {_NAME[3]} || 'haus, x' || {_NAME[0]} || '. ' || {_NAME[1]} || 's Brief an Frau Dr. ' "
    f"|| {_NAME[2]} || ' Meier, ' || {_BORN} || ' ' || {_DATE} || ', ' || {_STREET} || ' ' || (coalesce(doc_id, 0) % 150 + 1) || '; ' || {_NAME[3]} || ' wohnhaft in Essen, Tel. 0201/' || (100000 + coalesce(doc_id, 0) % 900000) || ', post.' || coalesce(doc_id, 0) || '@example.org'"
)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(LETTER).alias("text"))


def name_spans(spark, sf_dir):
    """Every place of a given name or one of its inflections."""
    gazetteer = values(spark, [(n,) for n in names.GIVEN_NAMES], "name string")
    return names.name_spans(_letters(spark, sf_dir), gazetteer)


def personal_spans(spark, sf_dir):
    """What all detectors find, each by itself."""
    return pii.detected(_letters(spark, sf_dir), names.GIVEN_NAMES)


def personal_spans_chosen(spark, sf_dir):
    """The same without overlaps: earlier detectors first, then longer and earlier spans."""
    return spans.without_overlaps(personal_spans(spark, sf_dir))


def masked_personal_data(spark, sf_dir):
    """Masking with names and ages; how many planted values are left (recall), whether the text comes back."""
    out = pii.masked(_letters(spark, sf_dir), names.GIVEN_NAMES, 2026)
    planted = F.array(F.expr("concat('post.', coalesce(doc_id, 0), '@example.org')"), F.expr("concat('0201/', 100000 + coalesce(doc_id, 0) % 900000)"), F.expr(f"concat({_NAME[2]}, ' Meier')"))
    left = F.size(F.filter(planted, lambda v: F.contains("masked", v)))
    return out.select("doc_id", left.cast("long").alias("n_left"), F.coalesce(pii.leaks(F.regexp_replace("masked", pii.PLACEHOLDER, ""), F.map_filter("mapping", lambda _, v: F.length(v) > 9)), F.lit(False)).alias("leaks"), F.md5("restored").alias("restored_md5"))


def reinsertion_integrity(spark, sf_dir):
    """Masked letters whose placeholders come back damaged, by id: whole, in single brackets, without the last bracket,
    in lower case with blanks, or lost; the values put back, and the share of the letter that then stands."""
    kinds = ("none", "single brackets", "last bracket lost", "lower case and blanks", "placeholder lost")
    damage = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.coalesce("doc_id", F.lit(0)) % len(kinds) + 1).cast("int"))
    rows = pii.masked(_letters(spark, sf_dir), names.GIVEN_NAMES, 2026).withColumn("damage", damage)
    inner = r"\[\[([A-Z_]+_[0-9]+)\]\]"
    broken = F.when(F.col("damage") == kinds[1], F.regexp_replace("masked", inner, "[$1]")).when(F.col("damage") == kinds[2], F.regexp_replace("masked", inner, "[[$1]"))
    broken = broken.when(F.col("damage") == kinds[3], F.regexp_replace("masked", inner, "[[ $1 ]]")).when(F.col("damage") == kinds[4], F.regexp_replace("masked", inner, "")).otherwise(F.col("masked"))
    back = reinsertion.reinserted(rows.select("doc_id", "damage", F.size("mapping").alias("n_values"), broken.alias("text"), "mapping", F.col("restored").alias("original")))
    return back.select("doc_id", "damage", "n_values", F.size("unknown").alias("n_unknown"), F.round("integrity", 6).alias("integrity"))


QUERIES = {f.__name__: f for f in (name_spans, personal_spans, personal_spans_chosen, masked_personal_data, reinsertion_integrity)}

# words with their places, joined with names times endings
_NAMES = ", ".join(f"('{n}')" for n in names.GIVEN_NAMES)
_PLACES = ", ".join(f"'{p.lower()}'" for p in names.PLACES)
_ENDINGS = ", ".join(f"('{e}')" for e in names.ENDINGS)
_NAME_SPANS = f"""
    letter AS (SELECT row_number() OVER () AS r, doc_id, {LETTER} AS text FROM documents),
    given (name) AS (VALUES {_NAMES}), ending (e) AS (VALUES {_ENDINGS}),
    form AS (SELECT name AS form, name FROM given UNION ALL SELECT name || e, name FROM given, ending WHERE length(name) >= 3 AND name || e NOT IN (SELECT name FROM given)),
    token AS (SELECT r, doc_id, text, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) AS k FROM letter),
    placed AS (SELECT *, sum(length(w)) OVER (PARTITION BY r ORDER BY k) - length(w) AS start FROM token),
    named AS (SELECT r, doc_id, start::INT AS start, (start + length(w))::INT AS "end", name FROM placed JOIN form ON form = w
        WHERE lower(w) NOT IN ({_PLACES}) AND (w <> name OR NOT regexp_matches(trim(substr(text, greatest(start::INT - 2, 1), least(3, start::INT)), ' \t\n'), '[.!?]$')))"""


def _detector(rank: int, kind: str, pattern: str) -> str:
    """Places of a pattern's matches: what splits the text and what is split off, added up; of a match, its group."""
    text = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{text}', 1)" if re.compile(pattern).groups else "m"
    return f"""SELECT r, doc_id, (s + strpos(m, {value}) - 1)::INT AS start, (s + strpos(m, {value}) - 1 + length({value}))::INT AS "end", {rank} AS rank, '{kind}' AS kind FROM (
        SELECT r, doc_id, m, sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + sum(length(m)) OVER (PARTITION BY r ORDER BY k) - length(m) AS s FROM (
            SELECT r, doc_id, unnest(found) AS m, unnest(gaps[: len(found)]) AS gap, generate_subscripts(found, 1) AS k
            FROM (SELECT r, doc_id, regexp_extract_all(text, '{text}') AS found, regexp_split_to_array(text, '{text}') AS gaps FROM letter) WHERE len(found) > 0))
        {f"WHERE NOT regexp_matches(m, '{pii.AUTHORITY}')" if kind == "ADRESSE" else ""}"""


_ALL_SPANS = f"{_NAME_SPANS}, every AS (" + " UNION ALL ".join(_detector(k, kind, p) for k, (kind, p) in enumerate(pii.PATTERNS.items())) + f""" UNION ALL SELECT r, doc_id, start, "end", {len(pii.PATTERNS)}, 'PERSON' FROM named)"""

ORACLE_SQL = {
    "name_spans": f'WITH {_NAME_SPANS} SELECT doc_id, start, "end", name FROM named',
    "personal_spans": f'WITH {_ALL_SPANS} SELECT doc_id, start, "end", rank, kind FROM every',
    # nothing that was planted is left, and every text comes back
    "masked_personal_data": f"SELECT doc_id, 0::BIGINT AS n_left, false AS leaks, md5({LETTER}) AS restored_md5 FROM documents",
    # one span after the other, against all that were kept before it
    "personal_spans_chosen": f"""WITH RECURSIVE {_ALL_SPANS},
    ordered AS (SELECT doc_id, list({{'s': start, 'e': "end", 'rank': rank, 'kind': kind}} ORDER BY rank, start - "end", start) AS spans FROM every GROUP BY doc_id),
    fold AS (SELECT doc_id, spans, 0 AS k, spans[:0] AS kept FROM ordered UNION ALL
        SELECT doc_id, spans, k + 1, CASE WHEN len(list_filter(kept, lambda x: x.s < spans[k + 1].e AND spans[k + 1].s < x.e)) > 0 THEN kept ELSE list_append(kept, spans[k + 1]) END FROM fold WHERE k < len(spans))
    SELECT doc_id, x.s AS start, x.e AS "end", x.rank AS rank, x.kind AS kind FROM (SELECT doc_id, unnest(kept) AS x FROM fold WHERE k = len(spans))""",
}
