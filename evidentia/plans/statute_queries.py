"""Queries on statute pages. Each document is printed as one: its text is the first subsection of a paragraph, with
tags inside it, beside a table, an annex that is no paragraph, and tags that do not end."""

from pyspark.sql import functions as F

from evidentia.sources import statutes
from evidentia.sources.tables import table

_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_NUMBER = "(doc_id % 400 + 1) || CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE '' END"
_DAY = "'2024-03-' || (doc_id % 20 + 10)"
PAGE = f"""'<html><head><title>Gesetz ' || doc_id || '</title><meta name="date" content="' || {_DAY} || '"></head><body><div class="jnnorm" title="Einzelnorm"><div class="jnheader"><h3>'
 || '<span class="jnenbez">§ ' || {_NUMBER} || '</span> <span class="jnentitel">Pflichten &amp; Rechte</span></h3></div><div class="jnhtml"><div class="jurAbsatz">(1) <p>' || {_ESCAPED}
 || '</p></div><div class="jurAbsatz">(2) Zweiter <b>Absatz</b>. Er hat<br> zwei S&auml;tze.<ul><li>Eins<li>Zwei</ul></div><div class="jurAbsatz">(3) <table><tr><td>1</td></tr></table></div><div class="jurAbsatz"> </div>'
 || '</div></div><div class="jnnorm x"><span class="jnenbez">Anlage</span><div class="jurAbsatz">(1) Kein Paragraph.</div></div>'
 || CASE WHEN doc_id % 2 = 0 THEN '<div class="jnnorm"><span class="jnenbez">§ 9a</span><div class="jurAbsatz">Ohne Nummer</section></p>' ELSE '' END"""


def statute_chunks(spark, sf_dir):
    """Paragraphs, subsections and sentences of statute pages."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.expr(PAGE).alias("html"), F.when(F.col("doc_id") % 5 == 0, F.lit("SGB II")).alias("law"))
    return statutes.statute_rows(pages)


QUERIES = {"statute_chunks": statute_chunks}
ORACLE_SQL = {
    "statute_chunks": f"""
WITH d AS (SELECT doc_id, {_NUMBER} AS p, ({_DAY})::DATE AS in_force, CASE WHEN doc_id % 5 = 0 THEN 'SGB II' ELSE 'Gesetz ' || doc_id END AS law,
    trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ') AS body FROM documents),
s AS (SELECT doc_id, 1 AS ord, p, CASE WHEN body = '' THEN NULL ELSE '1' END AS sub, CASE WHEN body = '' THEN '(1)' ELSE body END AS body, law, in_force FROM d
    UNION ALL SELECT doc_id, 2, p, '2', 'Zweiter Absatz . Er hat zwei Sätze. Eins Zwei', law, in_force FROM d
    UNION ALL SELECT doc_id, 3, '9a', NULL, 'Ohne Nummer', law, in_force FROM d WHERE doc_id % 2 = 0),
parts AS (SELECT *, law || ' > § ' || p || coalesce(' > Abs. ' || sub, '') AS path, string_split(regexp_replace(body, '([.!?]) ([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS sentences FROM s),
unit AS (SELECT doc_id, ord, 0 AS k, 'absatz' AS unit, p, sub, NULL::INT AS sentence, path, coalesce('(' || sub || ') ', '') || body AS text, in_force FROM parts
    UNION ALL SELECT doc_id, ord, k, 'satz', p, sub, k::INT, path || ' > Satz ' || k, sentences[k], in_force FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS k FROM parts))
SELECT doc_id AS page_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, k))::INT AS n, unit, p AS paragraph, sub AS subsection, sentence, path, text, in_force FROM unit""",
}
