"""Queries on vector, keyword and fused retrieval. Query rows are those whose id is divisible by 100."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import contains
from evidentia.operators import retrieval as R
from evidentia.sources.tables import table, values


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return corpus.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), corpus


def vector_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _legs(spark, sf_dir)
    found = R.vector_search(queries, corpus, k=10, threshold=1.0)
    return found.join(corpus.select("chunk_id", "label"), "chunk_id").select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank", "label")


def vector_threshold_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _legs(spark, sf_dir)
    return R.distances(queries, corpus, below=0.9).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_below"))


def vector_best_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all questions: every chunk once, at its smallest distance to any of them, the first twelve."""
    queries, corpus = _legs(spark, sf_dir)
    found = R.vector_search(queries, corpus, k=10)
    best = R.first_seen(found, ["chunk_id"], ["distance", "query_id"])
    return best.orderBy("distance", "chunk_id").limit(12).select("chunk_id", "query_id", F.round("distance", 6).alias("distance"))


def _keyword_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold most of the eight best keywords of a query's text, wherever in a word they stand."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = T.with_keywords(docs.where("chunk_id % 100 = 0"))
    terms = queries.select(F.col("chunk_id").alias("query_id"), F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("term"))
    return contains.keyword_hits(terms, docs, k=5)


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword_leg(spark, sf_dir).select("query_id", "chunk_id", "hits", "rank", F.lit("keyword").alias("method"), F.lit(0.5).alias("distance"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a phrase of five words of a benchmark item anywhere, case aside."""
    phrase = F.regexp_extract(F.lower("text"), "^(?:[^ ]+ ){3}([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+)", 1)
    patterns = table(spark, sf_dir, "benchmark").select(phrase.alias("pattern"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return contains.phrases(patterns, texts).withColumnRenamed("id", "doc_id")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _legs(spark, sf_dir)
    fused = R.fuse(R.vector_search(queries, corpus, k=10), _keyword_leg(spark, sf_dir))
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.round(1 - F.col("score"), 9).alias("distance"))


def fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _legs(spark, sf_dir)
    first = R.vector_search(queries, corpus, k=10, threshold=0.7).select("query_id", "chunk_id", F.lit("vector").alias("method"))
    return R.with_fallback(first, _keyword_leg(spark, sf_dir).select("query_id", "chunk_id", F.lit("keyword").alias("method")), 3)


AREAS = (("sgb2", "src1"), ("sgb2", "src2"), ("miete", "src2"), ("miete", "src3"), ("familie", "src4"))


def multi_area_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per legal area: the ten longest texts of the area's sources, merged with the first area winning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    areas = values(spark, [(a, s, i) for i, (a, s) in enumerate(AREAS)], "area string, source string, ord int")
    joined = docs.join(F.broadcast(areas), "source")
    ranked = R.top_k(joined.withColumn("chunk_id", F.col("doc_id")), 10, "area", (F.desc("size"), "chunk_id"))
    firsts = joined.groupBy("area").agg(F.min("ord").alias("area_ord"))
    return R.first_seen(ranked.join(firsts, "area"), ["doc_id"], ["area_ord"]).select("area", "doc_id", "size", "rank")


def norm_ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in notices: the documents hold none, so most are given some of their own.

    One in seven cites a statute that is not known, one in five cites nothing.
    """
    number = lambda k: (F.col("doc_id") % k).cast("string")
    letter, clause = F.when(F.col("doc_id") % 3 == 0, "b").otherwise(""), F.when(F.col("doc_id") % 4 == 1, " Abs. 2 Satz 1").otherwise("")
    statute = F.when(F.col("doc_id") % 7 == 0, "XYZ").when(F.col("doc_id") % 2 == 0, "SGB  II n.F.").otherwise("BGB")
    cited = F.concat(F.lit("Nach § 1"), number(400), letter, clause, F.lit(" "), statute, F.lit(" und §§ 45/9"), number(50), F.lit(" SGB X gilt: "))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, "").otherwise(cited), F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", F.posexplode(T.norm_references(F.col("text"))).alias("pos", "norm"))


def norm_ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against a corpus of paragraphs by equality on the parsed element, at most five per citation."""
    docs = table(spark, sf_dir, "documents")
    paths = docs.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("SGB II > § "), (F.col("doc_id") % 60).cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit("b")).otherwise(F.lit("")), F.lit(" > Abs. 1")).alias("path"))
    refs = values(spark, [("§ 11b",), ("§ 14b",), ("§ 7",), ("§ 45",)], "paragraph string")
    parsed = paths.withColumn("paragraph", F.regexp_extract("path", "(§ [0-9]+[a-z]?)", 1))
    return R.top_k(parsed.join(F.broadcast(refs), "paragraph"), 5, "paragraph", ("chunk_id",)).select("paragraph", "chunk_id", "path", "rank", T.hierarchy_to_norm(F.col("path")).alias("norm"))


_FAR = """WITH far AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label,
  round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM far)"""
_KEYS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöüßÀ-ÿ]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-zÄÖÜäöüßÀ-ÿ]+'), 1) AS i FROM documents WHERE doc_id % 100 = 0),
 w1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS k FROM w WHERE length(w) > 2 AND lower(w) NOT IN ({", ".join(f"'{s}'" for s in T.STOP_WORDS)})),
 w8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(w, '^[A-ZÄÖÜÀ-Þ]') THEN 0 ELSE 1 END, -length(w), i) AS r FROM w1 WHERE k = 1),
 term AS (SELECT DISTINCT doc_id AS query_id, lower(w) AS term FROM w8 WHERE r <= 8),
 hit AS (SELECT query_id, d.doc_id AS chunk_id, count(*) AS hits FROM term JOIN documents d ON contains(lower(d.text), term) AND query_id <> d.doc_id GROUP BY ALL),
 key AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM hit) WHERE rank <= 5)"""

QUERIES = {f.__name__: f for f in (vector_topk_per_query, vector_threshold_count, vector_best_distance, keyword_search, phrase_search, hybrid_rrf, fallback_merge, multi_area_merge, norm_ref_extract, norm_ref_lookup)}
ORACLE_SQL = {
    "vector_topk_per_query": f"{_FAR} SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank, label FROM near WHERE rank <= 10 AND distance < 1.0",
    "vector_threshold_count": f"{_FAR} SELECT query_id, count(*) AS n_below FROM far WHERE distance < 0.9 GROUP BY query_id",
    "vector_best_distance": f"{_FAR}, best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY distance, query_id) AS k FROM near WHERE rank <= 10) SELECT chunk_id, query_id, round(distance, 6) AS distance FROM best WHERE k = 1 ORDER BY best.distance, chunk_id LIMIT 12",
    "keyword_search": f"WITH {_KEYS} SELECT query_id, chunk_id, hits, CAST(rank AS INTEGER) AS rank, 'keyword' AS method, CAST(0.5 AS DOUBLE) AS distance FROM key",
    "phrase_search": "WITH p AS (SELECT DISTINCT regexp_extract(lower(text), '^(?:[^ ]+ ){3}([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+)', 1) AS pattern FROM benchmark) SELECT pattern, doc_id FROM p JOIN documents ON contains(lower(text), pattern) WHERE pattern <> ''",
    "hybrid_rrf": f"""{_FAR}, {_KEYS} SELECT query_id, chunk_id, round(s, 9) AS score, round(1 - s, 9) AS distance FROM (
 SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, coalesce(CAST(1 AS DOUBLE) / (60 + v.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + k.rank), 0) AS s
 FROM (SELECT * FROM near WHERE rank <= 10) v FULL OUTER JOIN key k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id)""",
    "fallback_merge": f"""{_FAR}, {_KEYS}, v AS (SELECT query_id, chunk_id FROM near WHERE rank <= 10 AND distance < 0.7)
 SELECT query_id, chunk_id, 'vector' AS method FROM v UNION ALL
 SELECT query_id, chunk_id, 'keyword' AS method FROM key k WHERE query_id NOT IN (SELECT query_id FROM v GROUP BY query_id HAVING count(*) >= 3) AND NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = k.query_id AND v.chunk_id = k.chunk_id)""",
    "multi_area_merge": """WITH a(area, source, ord) AS (VALUES ('sgb2', 'src1', 0), ('sgb2', 'src2', 1), ('miete', 'src2', 2), ('miete', 'src3', 3), ('familie', 'src4', 4)),
 r AS (SELECT area, doc_id, length(text) AS size, row_number() OVER (PARTITION BY area ORDER BY length(text) DESC NULLS LAST, doc_id) AS rank FROM documents JOIN a USING (source)),
 f AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM r JOIN (SELECT area, min(ord) AS o FROM a GROUP BY area) USING (area) WHERE rank <= 10)
 SELECT area, doc_id, CAST(size AS INTEGER) AS size, CAST(rank AS INTEGER) AS rank FROM f WHERE k = 1""",
    "norm_ref_extract": """WITH c AS (SELECT doc_id, 0 AS place, '§ 1' || (doc_id % 400) || CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' SGB II' ELSE ' BGB' END AS norm FROM documents WHERE doc_id % 7 <> 0
 UNION ALL SELECT doc_id, 1, '§ 45 SGB X' FROM documents UNION ALL SELECT doc_id, 2, '§ 9' || (doc_id % 50) || ' SGB X' FROM documents)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS pos, norm FROM c WHERE doc_id % 5 <> 0""",
    "norm_ref_lookup": """WITH p AS (SELECT doc_id AS chunk_id, '§ ' || (doc_id % 60) || CASE WHEN doc_id % 7 = 0 THEN 'b' ELSE '' END AS paragraph FROM documents)
 SELECT paragraph, chunk_id, 'SGB II > ' || paragraph || ' > Abs. 1' AS path, CAST(rank AS INTEGER) AS rank, paragraph || ' Abs. 1 SGB II' AS norm
 FROM (SELECT *, row_number() OVER (PARTITION BY paragraph ORDER BY chunk_id) AS rank FROM p WHERE paragraph IN ('§ 11b', '§ 14b', '§ 7', '§ 45')) WHERE rank <= 5""",
}
