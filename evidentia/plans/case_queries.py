"""Queries on needs, labels, claims, spans, edits and gold sets."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.functions import labels as L
from evidentia.functions import needs as N
from evidentia.operators import evaluation as E
from evidentia.operators import metrics
from evidentia.sources.tables import table

#: Amounts that a parameter table adds to the fixed ones.
TABLE = (*N.BASE_NEEDS, (1993, 1, "390.00"), (1996, 1, "404.00"), (1996, 2, "364.00"))
_PEOPLE = ("alleinstehend", "partner", "alleinerziehend", "unbekannt")


def _cases(spark: SparkSession, sf_dir: str):
    items = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") < 3, F.col("l_quantity").cast(N.MONEY)).alias("amount")))).alias("items")
    )
    people = F.array(*[F.lit(p) for p in _PEOPLE])
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.get(people, (F.col("o_custkey") % 4).cast("int")).alias("person"), F.when(F.col("o_custkey") % 10 > 0, (F.col("o_totalprice") / 1000).cast(N.MONEY)).alias("shelter")
    )
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def need_assembly(spark, sf_dir):
    """Base need of the nearest year, shelter and extra needs of every case; unknown parts leave the need unknown."""
    return N.assembled(_cases(spark, sf_dir), TABLE).select("o_orderkey", "base", "extras", "need", "base_error")


def four_line_reconcile(spark, sf_dir):
    """Need, allowance, income and claim against an authority's numbers, one row a line."""
    d = lambda c: F.col(c).cast(N.MONEY)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), d("l_extendedprice").alias("need"), F.when(F.col("l_linenumber") < 6, (F.col("l_quantity") * 10).cast(N.MONEY)).alias("allowance"), (F.col("l_partkey") % 3000).cast(N.MONEY).alias("net"))
    rows = rows.withColumns({"need_a": d("need"), "allowance_a": F.lit(100).cast(N.MONEY), "income_a": d("net"), "claim_a": F.when(F.col("need") > 2000, d("need"))})
    return N.four_lines(rows, "line")


def claim_consistency(spark, sf_dir):
    """Cases whose stated claim is not need less income."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(N.MONEY).alias("need"), (F.col("o_custkey") * 100).cast(N.MONEY).alias("income"))
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast(N.MONEY)).when(F.col("o_orderkey") % 3 == 1, (F.col("need") - F.col("income")).cast(N.MONEY))
    rows = rows.withColumn("claim", stated)
    return rows.select("o_orderkey", "claim", N.claim_is_off(F.col("need"), F.col("income"), F.col("claim")).alias("off"))


def extraction_cross_check(spark, sf_dir):
    """Extracted amounts that are not written in their text in any of the usual forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" Miete 412,50 und 17.25 sowie 300 Euro")).alias("text"))
    amounts = F.array(F.lit(412.5), F.lit(17.25), F.lit(300.0), (F.col("doc_id") % 50 + 0.75), (F.col("doc_id") % 90).cast("double"))
    rows = docs.select("doc_id", "text", F.posexplode(amounts).alias("pos", "value"))
    return rows.where(~N.stands_in(F.col("value"), F.col("text"))).select("doc_id", "pos", "value")


def weekday_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(L.weekday_name(F.col("o_orderdate").cast("date")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def tolerant_dates(spark, sf_dir):
    """Dates in two ways of writing, and words that are none."""
    day = F.col("o_orderdate").cast("date")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.tolerant_date(written).alias("day"))


def egress_forms(spark, sf_dir):
    """Every document as leaks are looked for in it, told by a hash."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(L.egress_form(F.concat(F.lit("STRASSE Straße Müller ÉÈ "), "text"))).alias("form"))


_SAID = ("Sozialrecht ", "Erbschaft", "das Arbeitslosengeld II betreffend", "Trennung und Erben", "Steuerrecht", "nachfolge")


def area_names(spark, sf_dir):
    said = F.get(F.array(*[F.lit(s) for s in _SAID]), (F.col("event_id") % len(_SAID)).cast("int"))
    return table(spark, sf_dir, "events").groupBy(said.alias("said"), L.area_of(said).alias("area")).agg(F.count(F.lit(1)).alias("n"))


_RESULTS = ("Der Bescheid ist Teilweise Rechtswidrig.", "Er ist im Wesentlichen korrekt", "Das ist unzulässig", "Es ist kein Verwaltungsakt", "Offen")


def verdict_match(spark, sf_dir):
    """Verdicts in words against the expected ones; a case without an expectation has no score."""
    text = F.get(F.array(*[F.lit(s) for s in _RESULTS]), (F.col("o_orderkey") % len(_RESULTS)).cast("int"))
    expected = F.when(F.col("o_custkey") % 3 == 0, F.lit("rechtswidrig")).when(F.col("o_custkey") % 3 == 1, F.lit("teilweise_rechtswidrig"))
    verdict = L.verdict_of(text)
    score = F.when(expected.isNotNull(), F.when(F.coalesce(verdict == expected, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"), score.alias("match"))


def euro_labels(spark, sf_dir):
    """Amounts as text, and labels in words."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", L.euros(F.col("o_totalprice")).alias("amount"), F.concat(F.lit("frist_"), F.lower(F.element_at(F.split("o_orderpriority", "-"), 1))).alias("label"))
    return rows.select("o_orderkey", "amount", L.humanised(F.col("label"), {"frist_1": "Eilige Frist"}).alias("label"))


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("kind"), F.col("l_discount").alias("strength"), F.when(F.col("l_returnflag") == "N", F.lit("confirmed")).when(F.col("l_returnflag") == "A", F.lit("disputed")).alias("adjudication"))


def binding_verification(spark, sf_dir):
    """Claims of a case by the strength of their bindings, and how many of them a letter may use."""
    claims = _claims(spark, sf_dir)
    bindings = claims.where("l_linenumber < 6").select("claim_id", (F.col("strength") * 10).alias("strength"))
    status = E.binding_status(claims, bindings, "claim_id")
    ok = E.usable(F.col("verification"), F.col("adjudication"))
    return status.groupBy("verification").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("usable"))


def first_topic_claim(spark, sf_dir):
    """Per case the first usable claim that names the topic."""
    claims = _claims(spark, sf_dir).withColumn("text", F.concat(F.lit("Anspruch "), "kind")).where(F.col("adjudication") == "confirmed")
    return E.first_on_topic(claims, "l_orderkey", ["l_linenumber"], "text", ["anspruch f", "regelbedarf"]).select("l_orderkey", "claim_id")


def value_by_label(spark, sf_dir):
    """Of a case's line items the first value with a label, null where none has it."""
    items = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("value"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    return rows.select("l_orderkey", F.get(F.filter("items", lambda x: x["label"] == "R"), F.lit(0))["value"].alias("value"))


def issue_recall(spark, sf_dir):
    """Issues found against issues expected, as sets of citations, one to one and in order."""
    sets = lambda c, n: F.array_sort(F.collect_list(F.struct("n", F.array((F.col(c) % n).cast("string")).alias("s"))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey")
    sums = rows.groupBy("l_orderkey").agg(sets("l_partkey", 5).alias("found"), sets("l_suppkey", 5).alias("expected"))
    plain = lambda c: F.transform(c, lambda x: x["s"])
    return sums.select("l_orderkey", F.round(E.greedy_recall(plain("found"), plain("expected")), 6).alias("issue_recall"))


def citation_precision(spark, sf_dir):
    """Precision and recall of sets of citations per case."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 7).alias("found"), F.collect_set(F.col("l_suppkey") % 7).alias("expected"))
    return rows.select("l_orderkey", F.round(metrics.precision(F.col("found"), F.col("expected")), 6).alias("precision"), F.round(metrics.recall(F.col("found"), F.col("expected")), 6).alias("recall"))


def _spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", ((F.col("l_partkey") * 7) % 900).alias("start"), F.col("l_quantity").cast("long").alias("size"), "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "start", (F.col("start") + F.col("size")).alias("end"))


def masked_span_precision(spark, sf_dir):
    """Share of a text's masked spans that overlap an annotated one."""
    spans = _spans(spark, sf_dir)
    masked, noted = (spans.where(f"l_linenumber % 2 = {k}").drop("l_linenumber").distinct() for k in (1, 0))
    hits = E.spans_hit(masked, noted, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("hits"))
    sums = masked.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(hits, "l_orderkey", "left")
    return sums.select("l_orderkey", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("precision"))


def span_overlaps(spark, sf_dir):
    """Annotations that cut into the one before them."""
    return E.adjacent_overlaps(_spans(spark, sf_dir), "l_orderkey").select("l_orderkey", "start", "end", "before_start", "before_end")


def over_redaction(spark, sf_dir):
    """Strings that masking must leave alone and did not, per text; letters e stand for what a mask took."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("Bescheid vom 06.07.2026 über 563,00 Euro. "), "text").alias("text"))
    masked = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("563,00"), F.lit("[[IBAN_1]]"))).otherwise(F.col("text"))
    controls = F.array(F.lit("06.07.2026"), F.lit("563,00"), F.lit("steht nicht da"))
    return docs.groupBy(E.controls_lost(controls, F.col("text"), masked).alias("lost")).agg(F.count(F.lit(1)).alias("n"))


def claim_edits(spark, sf_dir):
    """Orders' states as the latest of their edits left them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    edits = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("state"))
    return E.edited(orders, edits, "o_orderkey", "state")


def restricted_delete(spark, sf_dir):
    """Customers with an even key are deleted: those with an urgent order stay, other orders lose their customer."""
    customers, orders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderpriority")
    kept, others = E.deleted_parents(customers, customers.where("k % 2 = 0"), "k", orders.where("o_orderpriority = '1-URGENT'"), orders.select("o_orderkey", "k"))
    return others.groupBy(F.col("k").isNull().alias("without")).agg(F.count(F.lit(1)).alias("orders")).crossJoin(kept.agg(F.count(F.lit(1)).alias("customers")))  # two rows with one


def freshness(spark, sf_dir):
    """Latest dates over all rows; open ends, which have none, do not count."""
    rows = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("valid_to"))
    return rows.agg(F.max("valid_to").cast("date").alias("valid_to"), F.max("ts").cast("date").alias("updated"), F.count(F.lit(1)).alias("n"))


def recent_completed(spark, sf_dir):
    """The latest fulfilled orders of every customer's list, a hundred of them."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


def transcripts(spark, sf_dir):
    """A conversation as one text: its first turn cut to four thousand characters, then the others by role."""
    line = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    said = F.transform(F.slice("turns", 2, 1_000_000), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"]))
    whole = F.concat_ws("\n", F.left(F.get("turns", F.lit(0))["text"], F.lit(4000)), said)
    return rows.select("conv_id", F.md5(whole).alias("transcript"), F.length(whole).alias("chars"))


def gold_summary(spark, sf_dir):
    """Per case its numbers of issues and citations, and whether its deadline was moved."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("issues"), F.collect_list("l_partkey").alias("citations"), F.max("l_shipdate").cast("date").alias("end"), F.min("l_shipdate").cast("date").alias("first"))
    moved = F.col("end") != F.add_months("first", 1)
    return rows.select("l_orderkey", F.size("issues").alias("issues"), F.size("citations").alias("citations"), moved.alias("moved"))


_FUNCTIONS = (need_assembly, four_line_reconcile, claim_consistency, extraction_cross_check, weekday_counts, tolerant_dates, egress_forms, area_names, verdict_match, euro_labels, binding_verification, first_topic_claim, value_by_label, issue_recall, citation_precision, masked_span_precision, span_overlaps, over_redaction, claim_edits, restricted_delete, freshness, recent_completed, transcripts, gold_summary)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_M = "DECIMAL(18,2)"
_VERDICT = "CASE o_orderkey % 5 WHEN 0 THEN 'teilweise_rechtswidrig' WHEN 1 THEN 'ueberwiegend_rechtmaessig' WHEN 2 THEN 'rechtswidrig' WHEN 3 THEN 'kein_verwaltungsakt' END"
_SPANS = "s AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7) % 900 AS start, (l_partkey * 7) % 900 + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem)"
ORACLE_SQL = {
    "need_assembly": f"""WITH i AS (SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity AS {_M})) FILTER (l_linenumber < 3), 0) AS {_M}) AS extras FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
 c AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey % 4 AS p, CASE WHEN o_custkey % 10 > 0 THEN CAST(o_totalprice / 1000 AS {_M}) END AS shelter FROM orders),
 b AS (SELECT *, CAST(CASE WHEN p IN (0, 2) THEN CASE WHEN y >= 2025 THEN 563 WHEN y >= 1996 THEN 404 ELSE 390 END WHEN p = 1 THEN CASE WHEN y >= 2025 THEN 506 ELSE 364 END END AS {_M}) AS base FROM c)
 SELECT o_orderkey, base, CAST(coalesce(extras, 0) AS {_M}) AS extras, CAST(base + shelter + coalesce(extras, 0) AS {_M}) AS need, CASE WHEN base IS NULL THEN 'Kein Regelbedarf für unbekannt' END AS base_error FROM b LEFT JOIN i ON o_orderkey = l_orderkey""",
    "four_line_reconcile": f"""WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS line, CAST(l_extendedprice AS {_M}) AS need, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity * 10 AS {_M}) END AS allowance, CAST(l_partkey % 3000 AS {_M}) AS net FROM lineitem),
 i AS (SELECT *, CASE WHEN net - allowance IS NOT NULL THEN CAST(greatest(0, net - allowance) AS {_M}) END AS income FROM r), c AS (SELECT *, CASE WHEN need - income IS NOT NULL THEN CAST(greatest(0, need - income) AS {_M}) END AS claim FROM i),
 l AS (SELECT line, 0 AS pos, 'Gesamtbedarf' AS label, need AS authority, need AS correct FROM c UNION ALL SELECT line, 1, 'Erwerbstätigenfreibetrag', CAST(100 AS {_M}), allowance FROM c UNION ALL SELECT line, 2, 'Anrechenbares Einkommen', net, income FROM c UNION ALL SELECT line, 3, 'Anspruch (Leistung)', CASE WHEN need > 2000 THEN need END, claim FROM c)
 SELECT *, CAST(correct - authority AS {_M}) AS difference FROM l""",
    "claim_consistency": f"""WITH r AS (SELECT o_orderkey, CAST(o_totalprice AS {_M}) AS need, CAST(o_custkey * 100 AS {_M}) AS income FROM orders), c AS (SELECT *, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN need - income END AS {_M}) AS claim FROM r)
 SELECT o_orderkey, claim, abs(claim - greatest(0, need - income)) > 0.02 AS off FROM c""",
    "extraction_cross_check": """WITH d AS (SELECT doc_id, coalesce(text, '') || ' Miete 412,50 und 17.25 sowie 300 Euro' AS text FROM documents), v AS (SELECT doc_id, text, 3 AS pos, doc_id % 50 + 0.75 AS value FROM d UNION ALL SELECT doc_id, text, 4, doc_id % 90 FROM d)
 SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value FROM v WHERE NOT (contains(text, format('{:.2f}', CAST(value AS DOUBLE))) OR contains(text, replace(format('{:.2f}', CAST(value AS DOUBLE)), '.', ',')) OR contains(text, replace(CAST(CAST(round(CAST(value AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS VARCHAR), '.', ',')) OR (pos = 4 AND contains(text, CAST(doc_id % 90 AS VARCHAR))))""",
    "weekday_counts": "SELECT ['Sonntag', 'Montag', 'Dienstag', 'Mittwoch', 'Donnerstag', 'Freitag', 'Samstag'][dayofweek(o_orderdate) + 1] AS weekday, count(*) AS n FROM orders GROUP BY 1",
    "tolerant_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "egress_forms": "SELECT doc_id, md5(replace(lower(strip_accents('STRASSE Straße Müller ÉÈ ' || text)), 'ß', 'ss')) AS form FROM documents WHERE text IS NOT NULL",
    "area_names": "SELECT ['Sozialrecht ', 'Erbschaft', 'das Arbeitslosengeld II betreffend', 'Trennung und Erben', 'Steuerrecht', 'nachfolge'][event_id % 6 + 1] AS said, ['sozialrecht', 'erbrecht', 'sozialrecht', 'erbrecht', NULL, 'erbrecht'][event_id % 6 + 1] AS area, count(*) AS n FROM events GROUP BY ALL",
    "verdict_match": f"SELECT o_orderkey, {_VERDICT} AS verdict, CASE o_custkey % 3 WHEN 0 THEN CAST(coalesce({_VERDICT} = 'rechtswidrig', false) AS DOUBLE) WHEN 1 THEN CAST(coalesce({_VERDICT} = 'teilweise_rechtswidrig', false) AS DOUBLE) END AS match FROM orders",
    "euro_labels": f"SELECT o_orderkey, CAST(CAST(o_totalprice AS {_M}) AS VARCHAR) || ' EUR' AS amount, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'Eilige Frist' ELSE 'Frist ' || split_part(o_orderpriority, '-', 1) END AS label FROM orders",
    "binding_verification": """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_discount * 10) AS best FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
 c AS (SELECT CASE WHEN best >= 0.8 THEN 'exakt' WHEN best IS NOT NULL THEN 'normalisiert' ELSE 'unverifiziert' END AS verification, l_returnflag = 'N' AS ok FROM lineitem LEFT JOIN b USING (l_orderkey, l_linenumber))
 SELECT verification, count(*) AS n, CAST(sum(CASE WHEN ok AND verification <> 'unverifiziert' THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM c GROUP BY 1""",
    "first_topic_claim": "SELECT l_orderkey, concat_ws('-', l_orderkey, min(l_linenumber)) AS claim_id FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F' GROUP BY 1",
    "value_by_label": "SELECT l_orderkey, (list(l_quantity ORDER BY l_linenumber, l_quantity) FILTER (l_returnflag = 'R'))[1] AS value FROM lineitem GROUP BY 1",
    "issue_recall": "WITH f AS (SELECT l_orderkey, l_partkey % 5 AS v, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey, l_suppkey % 5 AS v, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, sum(n) AS n FROM e GROUP BY 1), h AS (SELECT l_orderkey, sum(least(f.n, e.n)) AS n FROM f JOIN e USING (l_orderkey, v) GROUP BY 1) SELECT l_orderkey, CAST(round(coalesce(h.n, 0) / s.n, 6) AS DOUBLE) AS issue_recall FROM s LEFT JOIN h USING (l_orderkey)",
    "citation_precision": "WITH f AS (SELECT DISTINCT l_orderkey, l_partkey % 7 AS v FROM lineitem), e AS (SELECT DISTINCT l_orderkey, l_suppkey % 7 AS v FROM lineitem), b AS (SELECT l_orderkey, count(*) AS n FROM f JOIN e USING (l_orderkey, v) GROUP BY 1) SELECT l_orderkey, round(coalesce(b.n, 0) / nf, 6) AS precision, round(coalesce(b.n, 0) / ne, 6) AS recall FROM (SELECT l_orderkey, count(*) AS nf FROM f GROUP BY 1) JOIN (SELECT l_orderkey, count(*) AS ne FROM e GROUP BY 1) USING (l_orderkey) LEFT JOIN b USING (l_orderkey)",
    "masked_span_precision": f"WITH {_SPANS}, a AS (SELECT DISTINCT l_orderkey, start, \"end\" FROM s WHERE l_linenumber % 2 = 1) SELECT l_orderkey, round(avg(CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.l_linenumber % 2 = 0 AND b.l_orderkey = a.l_orderkey AND a.\"end\" > b.start AND a.start < b.\"end\") THEN 1.0 ELSE 0.0 END), 6) AS precision FROM a GROUP BY 1",
    "span_overlaps": f"WITH {_SPANS}, w AS (SELECT l_orderkey, start, \"end\", lag(start) OVER o AS before_start, lag(\"end\") OVER o AS before_end FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY start, \"end\")) SELECT * FROM w WHERE start < before_end AND \"end\" > before_end AND start > before_start",
    "over_redaction": "SELECT CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS lost, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "claim_edits": "WITH e AS (SELECT l_orderkey, (list(l_returnflag ORDER BY l_linenumber DESC, l_returnflag DESC))[1] AS new, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT o_orderkey, coalesce(new, o_orderstatus) AS state, coalesce(n, 0) AS n_edits FROM orders LEFT JOIN e ON o_orderkey = l_orderkey",
    "restricted_delete": "WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM u)) SELECT o_custkey IN (SELECT k FROM g) AS without, count(*) AS orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM g)) AS customers FROM orders GROUP BY 1",
    "freshness": "SELECT CAST(max(ts) FILTER (event_id % 2 = 0) AS DATE) AS valid_to, CAST(max(ts) AS DATE) AS updated, count(*) AS n FROM events",
    "recent_completed": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "transcripts": "WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS n FROM conversations), w AS (SELECT conv_id, string_agg(CASE WHEN n = 1 THEN left(text, 4000) ELSE upper(role) || ': ' || text END, chr(10) ORDER BY n) AS whole FROM t GROUP BY 1) SELECT conv_id, md5(whole) AS transcript, CAST(length(whole) AS INTEGER) AS chars FROM w",
    "gold_summary": "SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS issues, CAST(count(l_partkey) AS INTEGER) AS citations, CAST(max(l_shipdate) AS DATE) <> CAST(CAST(min(l_shipdate) AS DATE) + INTERVAL 1 MONTH AS DATE) AS moved FROM lineitem GROUP BY 1",
}
