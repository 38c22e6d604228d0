"""Queries on readiness, changes of tables, budgets, metrics, JSON and stateful folds."""

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import budget, metrics, tables
from evidentia.operators.asof import latest
from evidentia.sources.tables import table, values
from evidentia.streaming import stateful

AREAS = [("sgb2", "src1"), ("sgb2", "src2"), ("miete", "src3"), ("miete", "src99"), ("familie", "src98")]


def readiness_by_source(spark: SparkSession, sf_dir: str):
    """Labelled documents per source; sources without any stay, with a count of nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("quality").alias("n_labelled"), F.count(F.lit(1)).alias("n_docs"), F.max("n_chars").alias("most_chars"))


def area_readiness(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    areas = values(spark, AREAS, "area string, source string")
    joined = areas.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = joined.groupBy("area").agg(F.sum("n").alias("n_chunks"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("source")))), ",").alias("present"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") == 0, F.col("source")))), ",").alias("missing"))
    return out.withColumn("is_ready", (F.col("n_chunks") > 0) & (F.col("missing") == ""))


def latest_per_user(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def _split(spark, sf_dir):
    """The events of the first and of the second half of the month, as keys with their last value."""
    keyed = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    last = lambda d: latest(d, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last(keyed.where(F.col("ts") < half)), last(keyed.where(F.col("ts") >= half))


def upsert_latest(spark, sf_dir):
    now, new = _split(spark, sf_dir)
    return tables.upserted(now, new, ["user_id", "event_type"], ["ts"]).select("user_id", "event_type", "event_id", "value")


def changed_rows(spark, sf_dir):
    now, new = _split(spark, sf_dir)
    bare = lambda d: d.select("user_id", "event_type", F.floor(F.col("value") / 40).alias("value"))
    return tables.changed(bare(now), bare(new), ["user_id", "event_type"], ["value"])


def ttl_cache_lookup(spark, sf_dir):
    """Each event as a cache entry that lives as many hours as its value says; entries alive at mid-month."""
    entries = table(spark, sf_dir, "events").select("event_id", tables.cache_key("ev", F.col("event_type"), F.col("props")).alias("key"), "ts", (F.col("ts") + F.make_dt_interval(hours=F.floor(F.col("value")).cast("int"))).alias("expires_at"))
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return tables.cached(entries.where(F.col("ts") <= at), at).select("event_id", "key")


def case_export_json(spark, sf_dir):
    """Orders with their line items nested in order, as one JSON text each."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    cases = tables.nested(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["n"], "lines")
    return cases.select("o_orderkey", F.size("lines").alias("n_lines"), F.md5(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "lines"))).alias("json_md5"))


def json_path(spark, sf_dir):
    """A dotted path with a default, tolerant of what is no number."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1))
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("n_default"))


def history_budget(spark, sf_dir):
    """The newest messages of every conversation within 600 characters."""
    out = budget.kept(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 600)
    return out.select("conv_id", "turn", "kept_chars")


def context_budget(spark, sf_dir):
    """Per source, its first documents as context of at most twelve chunks and 7000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return budget.kept(docs.withColumn("n", rank).where("n <= 12"), "source", ["n"], 7000).select("source", "doc_id", "n", "kept_chars")


def latest_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 2")
    return c.select("conv_id", "turn", "role", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


def precision_recall(spark, sf_dir):
    """How well a rule, marks that prose has none of, finds documents labelled of low quality, per language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("lang", (1 - F.col("quality")).alias("bad"), F.rlike("text", F.lit("[$%&*#]{2,}")).cast("int").alias("said"))
    return metrics.rates(rows, ["lang"], "bad", "said")


def _report(spark, sf_dir, flag):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") <= flag)
    sums = rows.groupBy(F.col("l_suppkey").alias("case_id")).agg(F.max("l_quantity").alias("recall"), F.min("l_discount").alias("leakage"), F.max("l_tax").alias("deadline"))
    return sums.unpivot("case_id", ["recall", "leakage", "deadline"], "metric", "value")


def gate_compare(spark, sf_dir):
    found = metrics.gate(_report(spark, sf_dir, 3), _report(spark, sf_dir, 2))
    return found.groupBy("metric", "outcome").agg(F.count(F.lit(1)).alias("n"))


def metric_means(spark, sf_dir):
    """Means that skip nulls: toxicity of the labelled documents alone."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.round(F.avg("toxic"), 6).alias("toxic_mean"), F.round(F.avg("quality"), 6).alias("quality_mean"), F.count("toxic").alias("n"))


def stage_delta(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", (micros - F.lag(micros).over(order)).alias("since_last"))


def stage_latency(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("event_type", "total", "n", F.round(F.col("total").cast("double") / F.col("whole").cast("double"), 6).alias("share"))


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts")


def rate_limit_admit(spark, sf_dir):
    return stateful.rate_limited(_requests(spark, sf_dir), limit=3, seconds=6 * 3600)


def session_fold(spark, sf_dir):
    return stateful.sessions(_requests(spark, sf_dir), gap_seconds=4 * 3600, most_turns=4)


_LAST = "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
_HALVES = f"WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' {_LAST}), b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16' {_LAST})"
_REPORT = "SELECT l_suppkey AS case_id, {0} AS metric, {1} AS value FROM lineitem WHERE l_linenumber <= {2} GROUP BY l_suppkey"
_REPORTS = lambda n: " UNION ALL ".join(_REPORT.format(m, v, n) for m, v in (("'recall'", "max(l_quantity)"), ("'leakage'", "min(l_discount)"), ("'deadline'", "max(l_tax)")))

QUERIES = {
    f.__name__: f
    for f in (readiness_by_source, area_readiness, latest_per_user, upsert_latest, changed_rows, ttl_cache_lookup, case_export_json, json_path, history_budget, context_budget, latest_messages, precision_recall, gate_compare, metric_means, stage_delta, stage_latency, rate_limit_admit, session_fold)
}
ORACLE_SQL = {
    "readiness_by_source": "SELECT source, count(quality) AS n_labelled, count(*) AS n_docs, max(n_chars) AS most_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "area_readiness": """WITH a(area, source) AS (VALUES ('sgb2', 'src1'), ('sgb2', 'src2'), ('miete', 'src3'), ('miete', 'src99'), ('familie', 'src98')), c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
 j AS (SELECT area, source, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (source)), g AS (SELECT area, CAST(sum(n) AS BIGINT) AS n_chunks, coalesce(string_agg(CASE WHEN n > 0 THEN source END, ',' ORDER BY source), '') AS present, coalesce(string_agg(CASE WHEN n = 0 THEN source END, ',' ORDER BY source), '') AS missing FROM j GROUP BY area)
 SELECT *, n_chunks > 0 AND missing = '' AS is_ready FROM g""",
    "latest_per_user": f"SELECT user_id, event_type, event_id, value FROM events {_LAST}",
    "upsert_latest": f"SELECT user_id, event_type, event_id, value FROM events {_LAST}",
    "changed_rows": _HALVES + """ SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'insert' WHEN b.user_id IS NULL THEN 'absent' WHEN floor(a.value / 40) IS NOT DISTINCT FROM floor(b.value / 40) THEN 'keep' ELSE 'update' END AS action
 FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
    "ttl_cache_lookup": "SELECT event_id, 'ev:' || sha256(event_type || chr(0) || props) AS key FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND ts + to_hours(CAST(floor(value) AS INTEGER)) > TIMESTAMP '2024-01-15'",
    "case_export_json": """WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS j FROM lineitem GROUP BY 1)
 SELECT o_orderkey, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, md5('{"status":"' || o_orderstatus || '","lines":[' || coalesce(j, '') || ']}') AS json_md5 FROM orders LEFT JOIN l USING (o_orderkey)""",
    "json_path": "SELECT event_type, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1)) AS BIGINT) AS sum_k, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS n_default FROM events GROUP BY event_type",
    "history_budget": """WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, sum(coalesce(length(text), 0)) OVER w AS upto, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, turn, CAST(CASE WHEN upto <= 600 THEN n ELSE greatest(0, 600 - (upto - n)) END AS BIGINT) AS kept_chars FROM c WHERE upto <= 600 OR k = 1 OR 600 - (upto - n) > 100""",
    "context_budget": """WITH d AS (SELECT source, doc_id, length(text) AS n0, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 c AS (SELECT source, doc_id, n, coalesce(n0, 0) AS s, sum(coalesce(n0, 0)) OVER (PARTITION BY source ORDER BY n) AS upto FROM d WHERE n <= 12)
 SELECT source, doc_id, CAST(n AS INTEGER) AS n, CAST(CASE WHEN upto <= 7000 THEN s ELSE greatest(0, 7000 - (upto - s)) END AS BIGINT) AS kept_chars FROM c WHERE upto <= 7000 OR n = 1 OR 7000 - (upto - s) > 100""",
    "latest_messages": "SELECT conv_id, turn, role, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "precision_recall": """WITH r AS (SELECT lang, quality = 0 AS t, regexp_matches(text, '[$%&*#]{2,}') AS s FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT lang, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn FROM r GROUP BY lang)
 SELECT lang, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "gate_compare": f"""WITH b AS ({_REPORTS(3)}), c AS ({_REPORTS(2)}),
 j AS (SELECT coalesce(b.metric, c.metric) AS metric, CASE WHEN b.case_id IS NULL THEN 'new' WHEN c.case_id IS NULL THEN 'fail' WHEN CASE WHEN b.metric = 'leakage' THEN c.value > b.value ELSE c.value < b.value END THEN CASE WHEN b.metric = 'recall' THEN 'warn' ELSE 'fail' END ELSE 'pass' END AS outcome
 FROM b FULL OUTER JOIN c ON b.case_id = c.case_id AND b.metric = c.metric) SELECT metric, outcome, count(*) AS n FROM j GROUP BY ALL""",
    "metric_means": "SELECT lang, round(avg(toxic), 6) AS toxic_mean, round(avg(quality), 6) AS quality_mean, count(toxic) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "stage_delta": "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since_last FROM events",
    "stage_latency": "WITH s AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, count(*) AS n FROM events GROUP BY 1) SELECT event_type, total, n, round(CAST(total AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM s), 6) AS share FROM s",
    "session_fold": """WITH m AS (SELECT user_id AS client, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m)
 SELECT client, session, min(ts) AS started, max(ts) AS ended, least(count(*), 4) AS turns, CASE WHEN count(*) >= 4 THEN 'completed' ELSE 'abandoned' END AS status FROM s GROUP BY client, session""",
}
