"""Queries on interviews, cases written by a stream, replayed edits and stages that run again."""

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.operators import edits, stages
from evidentia.sources.tables import new_folder, table
from evidentia.streaming import commits, interviews


def interview_sessions(spark: SparkSession, sf_dir: str):
    """Events as interviews of at most four turns: a purchase confirms, an error restarts, four hours of silence end one."""
    action = F.when(F.col("event_type") == "purchase", F.lit("confirm")).when(F.col("event_type") == "error", F.lit("restart"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts", action.alias("action"))
    return interviews.interviews(events, gap_seconds=4 * 3600, most_turns=4)


#: Orders and lines that are cached in one partition, some 250 bytes each; given to repartition(), as Spark would join partitions by their size in a shuffle, a seventh of that.
PART_ROWS = 250_000


def case_fan_out(spark, sf_dir):
    """Orders come as a stream, meet their lines and are written as cases with stages, claims, bindings and areas; the
    committed rows of all five tables, each with its place in the case and what it says."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag").alias("l"))
    n_parts = (lines.count() + table(spark, sf_dir, "orders").count()) // PART_ROWS + 1  # read from the files' footers
    listed = lines.repartition(n_parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")  # as a pattern the table may be a file or a folder
    orders = orders.repartition(n_parts, "o_orderkey")
    per_line = lambda f: F.transform("lines", f)
    cases = orders.join(listed, orders["o_orderkey"] == listed["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderstatus").alias("status"),
        per_line(lambda x: F.struct(F.concat(F.lit("line "), x["l_linenumber"]).alias("name"), x["l_quantity"].cast("long").alias("millis"))).alias("stages"),
        per_line(lambda x: F.struct(x["l_linenumber"].cast("long").alias("claim_id"), x["l_returnflag"].alias("text"), F.array(F.struct(x["l_partkey"].alias("chunk_id"), x["l_tax"].alias("strength")), F.struct(x["l_suppkey"].alias("chunk_id"), F.lit(0.0).alias("strength"))).alias("bindings"))).alias("claims"),
        per_line(lambda x: x["l_returnflag"]).alias("areas"),
    )
    folder = new_folder(spark, "cases")
    commits.fanned_out(cases, folder, "case_fan_out", commits.CASE_TABLES).trigger(availableNow=True).start().awaitTermination()
    said = {
        "cases": (F.lit(0), F.col("status")),
        "stages": (F.col("pos"), F.concat_ws(" ", "name", "millis")),
        "claims": (F.col("pos"), F.concat_ws(" ", "claim_id", "text", "n_bindings")),
        "bindings": (F.col("pos"), F.concat_ws(" ", "claim_id", "chunk_id", F.floor(F.col("strength") * 100 + 0.5))),
        "areas": (F.col("pos"), F.concat_ws(" ", "area", "is_primary")),
    }
    parts = [commits.committed(spark, folder, name).select(F.lit(name).alias("table"), "case_id", pos.cast("int").alias("pos"), what.alias("what")) for name, (pos, what) in said.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


INSTANTS = [dt.datetime(2024, 1, d) for d in (8, 16, 31)]
#: What an event of a type says of its user's object, as a JSON text; $k stands for the number in its properties.
PATCHES = {"view": '{"claim":{"seen":$k}}', "click": '{"claim":{"text":$k,"note":null}}', "purchase": '{"claim":{"note":{"n":$k}},"area":$k}', "signup": '{"claim":{"note":"$k"}}', "error": '{"claim":null,"area":{}}'}


def edit_states(spark, sf_dir):
    """Events as merge patches on their users' objects: what these held at three instants."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    patch = F.lit(None).cast("string")
    for kind, text in PATCHES.items():
        patch = F.when(F.col("event_type") == kind, F.replace(F.lit(text), F.lit("$k"), k)).otherwise(patch)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("number"), patch.alias("patch"))
    out = edits.states(rows, INSTANTS)
    return out.select("key", F.to_date("instant").alias("day"), F.array_join("path", ".").alias("path"), "value")


def stages_to_rerun(spark, sf_dir):
    """The events of the last days change stages of their users' cases: what must run again, and how far down it lies."""
    names = list(dict.fromkeys(s for pair in stages.FEEDS for s in pair))
    stage = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    recent = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    return stages.to_rerun(recent.select(F.col("user_id").alias("case_id"), stage.alias("stage"))).select("case_id", "stage", "steps", "cyclic")


QUERIES = {f.__name__: f for f in (interview_sessions, case_fan_out, edit_states, stages_to_rerun)}

_STAGES = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in stages.FEEDS)
_NAMES = "[" + ", ".join(f"'{n}'" for n in dict.fromkeys(s for pair in stages.FEEDS for s in pair)) + "]"
ORACLE_SQL = {
    "interview_sessions": """WITH e AS (SELECT user_id AS client, epoch_us(ts) AS us, event_id, min(CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'restart' ELSE 'turn' END) AS action
 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2, 3),
 p AS (SELECT *, lag(us) OVER w AS before, lag(action) OVER w AS was FROM e WINDOW w AS (PARTITION BY client ORDER BY us, event_id)),
 s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 14400000000 OR was = 'restart' THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM p),
 k AS (SELECT *, count(*) FILTER (action <> 'restart') OVER (PARTITION BY client, n ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s),
 d AS (SELECT *, min(k) FILTER (action = 'confirm' OR (action = 'turn' AND k = 4)) OVER (PARTITION BY client, n) AS stop FROM k)
 SELECT client, arg_min(event_id, (us, event_id)) AS first_event, min(us) AS started, max(us) FILTER (action = 'restart' OR stop IS NULL OR k <= stop) AS ended,
 count(*) FILTER (action <> 'restart' AND (stop IS NULL OR k <= stop)) AS turns, count(*) FILTER (action <> 'restart' AND k > stop) AS refused,
 CASE WHEN count(*) FILTER (action = 'restart') = 0 AND max(stop) IS NOT NULL THEN 'completed' ELSE 'abandoned' END AS status FROM d GROUP BY client, n""",
    "case_fan_out": """WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_returnflag) - 1 AS INTEGER) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 f AS (SELECT l_orderkey, l_returnflag, min(pos) AS p FROM l GROUP BY ALL)
 SELECT 'cases' AS table, o_orderkey AS case_id, 0 AS pos, o_orderstatus AS what FROM orders
 UNION ALL SELECT 'stages', l_orderkey, pos, 'line ' || l_linenumber || ' ' || CAST(l_quantity AS BIGINT) FROM l
 UNION ALL SELECT 'claims', l_orderkey, pos, l_linenumber || ' ' || l_returnflag || ' 2' FROM l
 UNION ALL SELECT 'bindings', l_orderkey, 0, l_linenumber || ' ' || l_partkey || ' ' || CAST(floor(l_tax * 100 + 0.5) AS BIGINT) FROM l
 UNION ALL SELECT 'bindings', l_orderkey, 1, l_linenumber || ' ' || l_suppkey || ' 0' FROM l
 UNION ALL SELECT 'areas', l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1 AS INTEGER), l_returnflag || CASE WHEN p = 0 THEN ' true' ELSE ' false' END FROM f""",
    "edit_states": """WITH e AS (SELECT user_id AS key, event_type AS t, coalesce(json_extract_string(props, '$.k'), '0') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts FROM events WHERE ts IS NOT NULL),
 says(t, path, value) AS (VALUES ('view', 'claim.seen', '$k'), ('click', 'claim.text', '$k'), ('click', 'claim.note', NULL), ('purchase', 'claim.note.n', '$k'), ('purchase', 'area', '$k'), ('signup', 'claim.note', '"$k"'), ('error', 'claim', NULL), ('error', 'area.', NULL)),
 a AS (SELECT key, i AS day, path, n, replace(value, '$k', k) AS value FROM e JOIN says USING (t), (VALUES (DATE '2024-01-08'), (DATE '2024-01-16'), (DATE '2024-01-31')) d(i) WHERE ts <= i),
 b AS (SELECT key, day, path, max(n) AS n, arg_max(coalesce(value, '-'), n) AS value FROM a GROUP BY ALL)
 SELECT key, day, path, value FROM b WHERE value <> '-' AND NOT EXISTS (SELECT 1 FROM b o WHERE o.key IS NOT DISTINCT FROM b.key AND o.day = b.day AND o.n > b.n AND (starts_with(o.path, b.path || '.') OR starts_with(b.path, o.path || '.')))""",
    "stages_to_rerun": f"""WITH RECURSIVE f(stage, later) AS ({_STAGES}), c AS (SELECT DISTINCT user_id AS case_id, {_NAMES}[event_id % 9 + 1] AS stage FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND user_id IS NOT NULL),
 w AS (SELECT case_id, stage, 0 AS steps FROM c UNION SELECT case_id, later, steps + 1 FROM w JOIN f USING (stage))
 SELECT case_id, stage, min(steps) AS steps, false AS cyclic FROM w GROUP BY case_id, stage""",
}
