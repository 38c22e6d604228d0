"""Queries on JSON, uploads, area ranges, addition checks and audit rows."""

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import jsonx
from evidentia.operators import metrics
from evidentia.sources import files
from evidentia.sources.tables import table


def json_in_prose(spark: SparkSession, sf_dir: str):
    """Event properties within prose and fences, found again, with a clamped number and its default."""
    said = F.concat(F.lit("Ergebnis: ```json\n"), "props", F.lit("\n``` Ende {"))
    rows = table(spark, sf_dir, "events").select("event_id", jsonx.json_in(said).alias("j"))
    return rows.select("event_id", jsonx.confidence(F.col("j"), "$.k", 0.5).alias("k"), jsonx.confidence(F.col("j"), "$.none", 0.5).alias("none"))


def json_prefix_merge(spark, sf_dir):
    base, other = F.create_map(F.lit("id"), F.col("event_id").cast("string")), F.create_map(F.lit("type"), F.col("event_type"), F.lit("gap"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(jsonx.merged_with_prefix(base, other, "adversarial_")).alias("merged"))


def calculation_diff(spark, sf_dir):
    """Numbers of an order against those of its line items, key by key; what either lacks has no delta."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"), F.max("l_linenumber").cast("double").alias("last"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    expected = F.create_map(F.lit("lines"), F.lit(4.0), F.lit("total"), F.round("o_totalprice"))
    actual = F.create_map(F.lit("lines"), F.col("lines"), F.lit("last"), F.col("last"))
    return rows.select("o_orderkey", F.explode(jsonx.map_differences(expected, actual)).alias("d")).select("o_orderkey", "d.*")


def exact_match(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("key"), "l_quantity", "l_linenumber")
    expected = rows.select("l_suppkey", "key", F.when(F.col("l_linenumber") == 7, F.lit("viel")).otherwise(F.col("l_quantity").cast("string")).alias("value")).distinct()
    actual = rows.where("l_linenumber < 5").select("l_suppkey", "key", F.col("l_quantity").cast("string").alias("value")).distinct()
    return metrics.exact_matches(expected, actual, "l_suppkey")


def upload_kinds(spark, sf_dir):
    """Pages and documents as uploads: how each would be read, decoded from its bytes."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.lit("text/plain")).when(F.col("doc_id") % 3 == 1, F.lit("application/pdf")).otherwise(F.lit("video/mp4")).alias("content_type"), F.encode("text", "UTF-8").alias("data"))
    kind = files.upload_kind(F.col("content_type"), F.octet_length("data").cast("long"))
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(files.decoded(F.col("data")))).alias("chars"))


#: Inclusive ranges of paragraphs and the area they belong to; the first that fits counts.
RANGES = ((516, 534, "schenkung"), (1297, 1921, "familienrecht"), (1922, 2385, "erbrecht"))


def area_of_paragraph(spark, sf_dir):
    n = (F.col("o_orderkey") % 2600).cast("int")
    area = F.lit("sonstiges")
    for low, high, name in reversed(RANGES):
        area = F.when(n.between(low, high), F.lit(name)).otherwise(area)
    return table(spark, sf_dir, "orders").groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


def addition_check(spark, sf_dir):
    """Orders whose stated total is off the sum of their parts by more than two cents; labels become columns first."""
    part = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice").cast("decimal(18,2)"))), F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(part("A").alias("a"), part("N").alias("n"), part("R").alias("r"))
    rows = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("off", (F.col("o_totalprice").cast("decimal(18,2)") - (F.col("a") + F.col("n") + F.col("r"))).cast("decimal(18,2)"))
    return rows.where(F.abs("off") > F.lit("0.02").cast("decimal(18,2)")).select("o_orderkey", "a", "n", "r", "off")


def audit_rows(spark, sf_dir):
    """One case fanned out to its child rows, the first area of a case being the primary one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("areas"))
    return lines.select(F.col("l_orderkey").alias("case_id"), F.posexplode("areas").alias("pos", "area")).withColumn("is_primary", F.col("pos") == 0)


def conversation_touched(spark, sf_dir):
    """Conversations by their latest turn, most turns first, fifty of them: the list a user sees."""
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))
    return sums.orderBy(F.desc("last_turn"), "conv_id").limit(50)


def stage_share(spark, sf_dir):
    """Each user's events: their share of the value of their type, and the running total over time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    sums = events.groupBy(F.col("event_type").alias("_type")).agg(F.sum("value").cast("double").alias("_whole"))
    met = events.join(sums, F.col("event_type").eqNullSafe(F.col("_type")), "left")
    return met.select("event_id", F.round(F.col("value").cast("double") / F.col("_whole"), 9).alias("share"), F.sum("value").over(order).cast("decimal(18,2)").alias("running"))


QUERIES = {f.__name__: f for f in (json_in_prose, json_prefix_merge, calculation_diff, exact_match, upload_kinds, area_of_paragraph, addition_check, audit_rows, conversation_touched, stage_share)}
ORACLE_SQL = {
    "json_in_prose": "SELECT event_id, CAST(greatest(0, least(1, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.5))) AS DOUBLE) AS k, CAST(0.5 AS DOUBLE) AS none FROM events",
    "json_prefix_merge": "SELECT event_id, '{\"id\":\"' || event_id || '\",\"adversarial_type\":\"' || event_type || '\"}' AS merged FROM events",
    "calculation_diff": """WITH l AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS lines, CAST(max(l_linenumber) AS DOUBLE) AS last FROM lineitem GROUP BY 1), r AS (SELECT * FROM orders JOIN l ON o_orderkey = l_orderkey)
 SELECT o_orderkey, 'lines' AS key, CAST(4 AS DOUBLE) AS expected, lines AS actual, lines - 4 AS delta FROM r UNION ALL SELECT o_orderkey, 'total', round(o_totalprice), NULL, NULL FROM r UNION ALL SELECT o_orderkey, 'last', NULL, last, NULL FROM r""",
    "exact_match": """WITH r AS (SELECT DISTINCT l_suppkey, concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS key, l_quantity AS q, l_linenumber AS n FROM lineitem),
 e AS (SELECT l_suppkey, key, CASE WHEN n <> 7 THEN q END AS want FROM r), a AS (SELECT l_suppkey, key, q AS got FROM r WHERE n < 5)
 SELECT l_suppkey, coalesce(round(avg(CASE WHEN want IS NOT NULL THEN CASE WHEN abs(want - got) <= 0.005 THEN CAST(1 AS DOUBLE) ELSE 0 END END), 6), 1) AS exact_match, count(want) AS n FROM e LEFT JOIN a USING (l_suppkey, key) GROUP BY l_suppkey""",
    "upload_kinds": "SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' ELSE 'unbekannt' END AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "area_of_paragraph": "SELECT CASE WHEN n BETWEEN 516 AND 534 THEN 'schenkung' WHEN n BETWEEN 1297 AND 1921 THEN 'familienrecht' WHEN n BETWEEN 1922 AND 2385 THEN 'erbrecht' ELSE 'sonstiges' END AS area, count(*) AS n, min(n) AS least, max(n) AS most FROM (SELECT CAST(o_orderkey % 2600 AS INTEGER) AS n FROM orders) o GROUP BY 1",
    "addition_check": """WITH s AS (SELECT l_orderkey, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'A'), 0) AS DECIMAL(18,2)) AS a, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N'), 0) AS DECIMAL(18,2)) AS n, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'), 0) AS DECIMAL(18,2)) AS r FROM lineitem GROUP BY 1),
 t AS (SELECT o_orderkey, a, n, r, CAST(CAST(o_totalprice AS DECIMAL(18,2)) - (a + n + r) AS DECIMAL(18,2)) AS off FROM orders JOIN s ON o_orderkey = l_orderkey) SELECT * FROM t WHERE abs(off) > 0.02""",
    "audit_rows": "SELECT l_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS INTEGER) AS pos, l_returnflag AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) = 1 AS is_primary FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)",
    "conversation_touched": "SELECT conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 50",
    "stage_share": "SELECT event_id, round(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) / CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type) AS DOUBLE), 9) AS share, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS running FROM events",
}
