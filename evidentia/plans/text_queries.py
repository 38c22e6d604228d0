"""Queries on text kernels, chunks, quality, personal data and quotes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import ocr, pii
from evidentia.functions import text as T
from evidentia.operators import chunks, retrieval, verify
from evidentia.sources import html
from evidentia.sources.tables import table, values


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("normalized_md5"), F.md5(T.collapsed(F.col("text"))).alias("collapsed_md5"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.trimmed(F.col("text"), 80).alias("title"))


def keyword_extract(spark, sf_dir):
    return T.with_keywords(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def sentence_chunks(spark, sf_dir):
    return chunks.sentence_rows(_docs(spark, sf_dir)).select("doc_id", "n", "path", F.md5("text").alias("text_hash"))


def chunk_dedup(spark, sf_dir):
    """Get-or-create: every distinct text once, as its first document, with the hashes that version it."""
    keyed = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "source", T.text_hash(F.col("text")).alias("text_hash"), T.version_hash(F.col("text")).alias("version_hash"))
    return retrieval.first_seen(keyed, ["text_hash"], ["doc_id"])


def duplicate_keys(spark, sf_dir):
    keyed = _docs(spark, sf_dir).select(F.md5("text").alias("text_hash"), "doc_id")
    return keyed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def html_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("chars"))


def html_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


def quality_score(spark, sf_dir):
    return ocr.assessed(_docs(spark, sf_dir)).select("doc_id", F.round("letters", 6).alias("letters"), F.round("readable", 6).alias("readable"), F.round("german", 6).alias("german"), "artefacts", "language", F.round("score", 3).alias("score"))


def quality_gate(spark, sf_dir):
    return ocr.assessed(_docs(spark, sf_dir)).groupBy("level", "gate", "language").agg(F.count(F.lit(1)).alias("n"))


def pii_detect_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[pii.counted(F.coalesce("text", F.lit("")), k).cast("long").alias(f"n_{k.lower()}") for k in ("BG_NUMMER", "IBAN", "EMAIL", "TELEFON")])


def pii_mask(spark, sf_dir):
    """Masking, unmasking and what leaks; a round trip has to give the text back."""
    out = pii.masked(_docs(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.size("mapping").alias("n_values"), (F.col("restored") == F.coalesce("text", F.lit(""))).alias("restored"), F.coalesce(pii.leaks(F.col("masked"), F.col("mapping")), F.lit(False)).alias("leaks"), F.md5("masked").alias("masked_md5"))


def quote_verify(spark, sf_dir):
    """Benchmark passages as quotes, looked up in all documents through the words they start with."""
    return verify.quotes_in(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))


def quote_rate(spark, sf_dir):
    found = verify.quotes_in(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)).select("item_id").distinct().withColumn("verified", F.lit(1))
    return table(spark, sf_dir, "benchmark").join(found, "item_id", "left").agg(F.count(F.lit(1)).alias("n_quotes"), F.sum(F.coalesce("verified", F.lit(0))).alias("n_verified"), F.round(F.avg(F.coalesce("verified", F.lit(0))), 6).alias("rate"))


KEYWORDS = (("miete", "licensed"), ("miete", "released"), ("familie", "password"), ("familie", "token"), ("arbeit", "the"), ("arbeit", "der"), ("arbeit", "les"))


def area_classify(spark, sf_dir):
    """Areas by how many of their keywords a text contains: the best is primary, the next two secondary."""
    dim = values(spark, [(a, k, i) for i, (a, k) in enumerate(KEYWORDS)], "area string, keyword string, ord int")
    words = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("keyword"))
    scored = words.join(F.broadcast(dim), "keyword").groupBy("doc_id", "area").agg(F.count(F.lit(1)).alias("score"))
    order = scored.join(F.broadcast(dim.groupBy("area").agg(F.min("ord").alias("area_ord"))), "area")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "area_ord"))
    return order.withColumn("rank", rank).where("rank <= 3").select("doc_id", "area", "score", F.when(F.col("rank") == 1, F.lit("primary")).otherwise(F.lit("secondary")).alias("role"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FUNCTION = ", ".join(f"'{w}'" for w in ocr.FUNCTION_WORDS)
_OCR = f"""WITH b AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents),
 c AS (SELECT doc_id, t, length(regexp_replace(t, '[ \\n\\t]', '', 'g')) AS solid,
  length(regexp_replace(regexp_replace(t, '[ \\n\\t]', '', 'g'), '\\p{{L}}', '', 'g')) AS bare,
  length(regexp_replace(regexp_replace(t, '[ \\n\\t]', '', 'g'), '[^@#$%^&*=_+{{}}\\[\\]|\\\\<>~`\\x00-\\x1F\\x7F]', '', 'g')) AS bad,
  list_transform(regexp_extract_all(t, '[a-zäöüßA-ZÄÖÜ]{{2,}}'), lambda w: lower(w)) AS words, regexp_extract_all(lower(t), '[a-zäöüß]+') AS low,
  regexp_matches(t, '[0-9][Oo]|[Oo][0-9]|[^0-9]l[0-9]|[0-9]l[0-9]|[a-zäöüß]-[ \\t\\r]*\\n[a-zäöüß]') OR regexp_matches(t, '[@#$%^&*=_+{{}}\\[\\]|\\\\<>~`]') AS artefacts,
  regexp_matches(t, '[äöüßÄÖÜ]') AS uml, regexp_matches(t, '[.!?]') AS ends FROM b),
 d AS (SELECT *, CASE WHEN solid > 0 THEN CAST(solid - bare AS DOUBLE) / solid ELSE 0 END AS letters, CASE WHEN solid > 0 THEN CAST(bad AS DOUBLE) / solid ELSE 0 END AS garbage,
  CASE WHEN len(words) > 0 THEN CAST(len(list_filter(words, lambda w: w IN ({_FUNCTION}) OR (length(w) > 2 AND regexp_matches(w, '[aeiouäöü]')))) AS DOUBLE) / len(words) ELSE 0 END AS readable,
  CASE WHEN len(low) > 0 THEN CAST(len(list_filter(low, lambda w: w IN ({_FUNCTION}))) AS DOUBLE) / len(low) ELSE 0 END AS german FROM c),
 e AS (SELECT *, CASE WHEN (uml AND len(low) > 0) OR german >= 0.15 THEN 'de' ELSE 'unknown' END AS language,
  CASE WHEN length(t) > 0 THEN round(greatest(0, least(1, CAST(0.3 AS DOUBLE) * least(1.0, letters / CAST(0.8 AS DOUBLE)) * greatest(0.0, 1 - garbage * 8) + CAST(0.3 AS DOUBLE) * readable + CAST(0.25 AS DOUBLE) * least(1.0, german / CAST(0.25 AS DOUBLE)) + CAST(0.15 AS DOUBLE) * CASE WHEN ends THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CASE WHEN artefacts THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)), 4) ELSE 0 END AS score FROM d)"""

QUERIES = {f.__name__: f for f in (normalize_text, token_estimate, keyword_extract, sentence_chunks, chunk_dedup, duplicate_keys, html_blocks, html_links, quality_score, quality_gate, pii_detect_counts, pii_mask, quote_verify, quote_rate, area_classify)}
ORACLE_SQL = {
    "normalize_text": """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{FEFF}\\x{00AD}]', '', 'g'), '[ \\t\\x{00A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', ''), ' ')) AS normalized_md5,
 md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{00A0}\\x{202F}]', ' ', 'g'), '[\\x{200B}-\\x{200D}\\x{FEFF}\\x{00AD}]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ')) AS collapsed_md5 FROM documents""",
    "token_estimate": "SELECT doc_id, CAST(ceil(CAST(length(text) AS DOUBLE) / 4) AS BIGINT) AS tokens, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS title FROM documents",
    "keyword_extract": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöüßÀ-ÿ]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-zÄÖÜäöüßÀ-ÿ]+'), 1) AS i FROM documents),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS k FROM w WHERE length(w) > 2 AND lower(w) NOT IN ({_STOP})),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(w, '^[A-ZÄÖÜÀ-Þ]') THEN 0 ELSE 1 END, -length(w), i) AS r FROM f WHERE k = 1)
 SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(r.w, ',' ORDER BY r.r), '') END AS keywords FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.r <= 8 GROUP BY d.doc_id, d.text""",
    "sentence_chunks": """WITH s AS (SELECT doc_id, source, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, source, list_filter(parts, lambda x: trim(x, ' ') <> '') AS parts FROM s)
 SELECT doc_id, CAST(n AS INTEGER) AS n, source || ' > Satz ' || n AS path, md5(parts[n]) AS text_hash FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS n FROM u)""",
    "chunk_dedup": "SELECT doc_id, source, md5(text) AS text_hash, sha256(text) AS version_hash FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
    "duplicate_keys": "SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "quality_score": _OCR + " SELECT doc_id, round(letters, 6) AS letters, round(readable, 6) AS readable, round(german, 6) AS german, artefacts, language, round(score, 3) AS score FROM e",
    "quality_gate": _OCR + " SELECT CASE WHEN score >= 0.8 THEN 'good' WHEN score >= 0.5 THEN 'acceptable' WHEN score >= 0.3 THEN 'poor' ELSE 'unusable' END AS level, CASE WHEN score < 0.3 THEN 'fail' WHEN score < 0.8 THEN 'warn' ELSE 'pass' END AS gate, language, count(*) AS n FROM e GROUP BY ALL",
    "pii_detect_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{pii.PATTERNS[k]}')) AS n_{k.lower()}" for k in ("BG_NUMMER", "IBAN", "EMAIL", "TELEFON")) + " FROM documents",
    "html_links": "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages WHERE html IS NOT NULL))",
    "quote_verify": "SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 'exakt' ELSE 'normalisiert' END AS status FROM benchmark b JOIN documents d ON contains(regexp_replace(lower(d.text), '[ \\t\\r\\n]+', ' ', 'g'), regexp_replace(lower(b.text), '[ \\t\\r\\n]+', ' ', 'g'))",
    "quote_rate": "WITH v AS (SELECT item_id, max(CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END) AS ok FROM benchmark b LEFT JOIN documents d ON contains(regexp_replace(lower(d.text), '[ \\t\\r\\n]+', ' ', 'g'), regexp_replace(lower(b.text), '[ \\t\\r\\n]+', ' ', 'g')) GROUP BY item_id) SELECT count(*) AS n_quotes, CAST(sum(ok) AS BIGINT) AS n_verified, round(avg(ok), 6) AS rate FROM v",
    "area_classify": """WITH a(area, keyword, ord) AS (VALUES ('miete', 'licensed', 0), ('miete', 'released', 1), ('familie', 'password', 2), ('familie', 'token', 3), ('arbeit', 'the', 4), ('arbeit', 'der', 5), ('arbeit', 'les', 6)),
 w AS (SELECT DISTINCT doc_id, k AS keyword FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM documents)),
 s AS (SELECT doc_id, area, count(*) AS score FROM w JOIN a USING (keyword) GROUP BY ALL),
 r AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS rank FROM s JOIN (SELECT area, min(ord) AS o FROM a GROUP BY area) USING (area))
 SELECT doc_id, area, score, CASE WHEN rank = 1 THEN 'primary' ELSE 'secondary' END AS role FROM r WHERE rank <= 3""",
}
