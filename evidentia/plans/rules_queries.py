"""Queries on deadlines, regimes, parameters and monetary rules; order dates are moved on by 29 years."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import dates as D
from evidentia.functions import money as M
from evidentia.operators import asof
from evidentia.sources.tables import table, values

FIRST, LAST, SHIFT = "2024-01-01", "2032-12-31", 348


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.add_months(F.col("o_orderdate").cast("date"), SHIFT))


def deadlines(spark, sf_dir):
    """Every order as a notice posted on its day; priority says how good its instruction is."""
    instruction = F.when(F.col("o_orderpriority").like("1%"), F.lit("fehlt")).when(F.col("o_orderpriority").like("2%"), F.lit("fehlerhaft")).otherwise(F.lit("korrekt"))
    notices = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("notice_id"), F.col("day").alias("dated"), F.col("day").alias("posted"), F.lit(None).cast("date").alias("received_on"), instruction.alias("instruction"), (F.col("o_orderstatus") != "P").alias("is_act"), F.lit("NW").alias("state"))
    out = D.deadlines(notices, D.calendar(spark, FIRST, LAST, ("NW",)))
    return out.select("notice_id", "received", "deadline", "kind", "rolled_over", "disputed", "other_deadline", D.document_type(F.col("kind"), F.col("deadline"), F.lit("2027-06-30").cast("date")).alias("document_type"))


def next_workday(spark, sf_dir):
    days = D.calendar(spark, FIRST, LAST, ("BW", "BY", "NW"))
    orders = _orders(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))
    return orders.join(F.broadcast(days), "day").select("day", "state", "is_workday", "next_workday", "n_orders")


def regime_of_date(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(D.regime_of(F.add_months("day", -24)).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def regime_segments(spark, sf_dir):
    periods = _orders(spark, sf_dir).select("o_orderkey", F.add_months("day", -24).alias("start"), F.add_months("day", -6).alias("end"))
    return D.regime_segments(periods)


PARAMETERS = [("F", "2024-01-01", "2025-12-31", 563.0), ("F", "2025-01-01", None, 570.0), ("O", "2024-06-01", "2026-05-31", 451.0), ("O", "2028-01-01", None, 471.0), ("P", "2026-01-01", "2026-12-31", 357.0)]


def asof_param(spark, sf_dir):
    """Orders with the parameter of their status that holds on their day, the latest start winning overlaps."""
    versions = values(spark, PARAMETERS, "o_orderstatus string, valid_from string, valid_to string, amount double").withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "day")
    return asof.as_of(rows, versions, "day", ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", F.col("version.amount").alias("amount"), F.col("version.valid_from").alias("valid_from"))


def _incomes(spark, sf_dir):
    gross = F.round(F.pmod(F.col("o_totalprice"), F.lit(2000.0)), 2).cast(M.MONEY)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", gross.alias("gross"), (F.col("o_orderkey") % 3 == 0).alias("has_child"))


def tariff_brackets(spark, sf_dir):
    return _incomes(spark, sf_dir).select("o_orderkey", "gross", M.allowance(F.col("gross"), F.col("has_child")).alias("allowance"), M.allowance(F.col("gross"), F.lit(False), old=True).alias("old_allowance"), M.offset(F.col("gross") - 1000).alias("offset"))


def need_reconcile(spark, sf_dir):
    """Need, income and claim of every order's household; the allowance comes off the net income."""
    rows = _incomes(spark, sf_dir).select("o_orderkey", (F.col("gross") * F.lit("0.80").cast("decimal(3,2)")).cast(M.MONEY).alias("net"), M.allowance(F.col("gross"), F.col("has_child")).alias("allowance"), F.lit("1113.00").cast(M.MONEY).alias("need"))
    return M.reconciled(rows).select("o_orderkey", "net", "income", "claim")


def discrepancy_totals(spark, sf_dir):
    """Line items as granted and right amounts, four per mille apart by discount; totals and direction per order."""
    right = F.col("l_extendedprice").cast(M.MONEY)
    difference = (F.round(F.col("l_discount").cast("decimal(4,2)") * 100).cast("int") - 5) * F.lit("0.01").cast("decimal(4,2)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", difference.cast(M.MONEY).alias("difference"), right.alias("right"))
    return M.totals(rows, ["l_orderkey"])


def month_aggregate(spark, sf_dir):
    """Per month and label: sums, rows, and the sum of absolute summed differences."""
    rows = table(spark, sf_dir, "lineitem").select(F.date_format(F.col("l_shipdate"), "yyyy-MM").alias("month"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast(M.MONEY).alias("right"), (F.col("l_quantity") - F.col("l_linenumber") * 8).cast(M.MONEY).alias("difference"))
    sums = rows.groupBy("month", "label").agg(F.sum("right").cast(M.MONEY).alias("sum_right"), F.sum("difference").cast(M.MONEY).alias("sum_difference"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("month_abs", F.sum(F.abs("sum_difference")).over(Window.partitionBy("month")).cast(M.MONEY))


#: Easter Sundays as published, to hold the rule against.
_EASTER = ("2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28", "2028-04-16", "2029-04-01", "2030-04-21", "2031-04-13", "2032-03-28", "2033-04-17")


def _holidays(states) -> str:
    import datetime as dt

    rows = []
    for state in states:
        for easter in map(dt.date.fromisoformat, _EASTER):
            year = easter.year
            days = [dt.date(year, *x) for x in (*D.FIXED_ALL, *D.FIXED_BY_STATE[state])] + [easter + dt.timedelta(days=k) for k in (*D.MOVABLE_ALL, *((D.CORPUS_CHRISTI,) if state in D.CORPUS_CHRISTI_STATES else ()))]
            rows += [f"(DATE '{d}', '{state}')" for d in sorted(set(days))]
    return ", ".join(rows)


def _calendar(states) -> str:
    names = ", ".join(f"('{s}')" for s in states)
    return f"""hol(day, state) AS (VALUES {_holidays(states)}), st(state) AS (VALUES {names}),
 dd AS (SELECT CAST(d AS DATE) AS day, state, isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM hol h WHERE h.day = CAST(d AS DATE) AND h.state = st.state) AS is_workday FROM range(DATE '2024-01-01', DATE '2033-01-31', INTERVAL 1 DAY) t(d), st),
 cal AS (SELECT *, min(CASE WHEN is_workday THEN day END) OVER (PARTITION BY state ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_workday FROM dd)"""


_DAY = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 348 MONTH AS DATE)"
_REG = "(VALUES ('a.F._vor_2023', DATE '0001-01-01', DATE '2023-06-30'), ('a.F._2023', DATE '2023-07-01', DATE '2024-12-31'), ('a.F._2025', DATE '2025-01-01', DATE '2026-06-30'), ('n.F._2026', DATE '2026-07-01', DATE '9999-12-31'))"
_GROSS = "CAST(round(o_totalprice % 2000.0, 2) AS DECIMAL(18,2))"


def _part(low, high, rate, gross="gross"):
    return f"CAST(round(greatest(CAST(0 AS DECIMAL(18,2)), least({gross}, CAST({high} AS DECIMAL(18,2))) - {low}) * CAST({rate} AS DECIMAL(5,4)), 2) AS DECIMAL(18,2))"


_ALLOW = " + ".join([_part(0, 100, 1), _part(100, 520, "0.2"), _part(520, 1000, "0.3"), _part(1000, "CASE WHEN child THEN 1500 ELSE 1200 END", "0.1")])
_OLD = " + ".join([_part(0, 100, 1), _part(100, 1000, "0.2"), _part(1000, 1200, "0.1")])

QUERIES = {f.__name__: f for f in (deadlines, next_workday, regime_of_date, regime_segments, asof_param, tariff_brackets, need_reconcile, discrepancy_totals, month_aggregate)}
ORACLE_SQL = {
    "deadlines": f"""WITH {_calendar(("NW",))}, n AS (SELECT o_orderkey AS notice_id, {_DAY} AS dated, o_orderstatus <> 'P' AS act, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 12 ELSE 1 END AS months FROM orders),
 r AS (SELECT *, dated + 4 AS receipt, CAST(dated + 4 + to_months(months) AS DATE) AS raw_end FROM n),
 j AS (SELECT r.*, e.next_workday AS end_next, c.next_workday AS receipt_next FROM r LEFT JOIN cal e ON e.day = raw_end LEFT JOIN cal c ON c.day = receipt),
 k AS (SELECT notice_id, CASE WHEN act THEN receipt ELSE dated END AS received, CASE WHEN act THEN end_next ELSE dated END AS deadline, CASE WHEN NOT act THEN 'kein_va' WHEN months = 1 THEN 'monat' ELSE 'jahr' END AS kind,
  act AND end_next <> raw_end AS rolled_over, act AND receipt_next <> receipt AS disputed, CASE WHEN act AND receipt_next <> receipt THEN CAST(receipt_next + INTERVAL 1 MONTH AS DATE) END AS other_deadline FROM j)
 SELECT *, CASE WHEN kind = 'kein_va' THEN 'akteneinsicht' WHEN deadline >= DATE '2027-06-30' AND kind = 'monat' THEN 'widerspruch' WHEN kind = 'jahr' THEN 'widerspruch_jahr' ELSE 'ueberpruefung' END AS document_type FROM k""",
    "next_workday": f"WITH {_calendar(('BW', 'BY', 'NW'))} SELECT day, state, is_workday, next_workday, n_orders FROM cal JOIN (SELECT {_DAY} AS day, count(*) AS n_orders FROM orders GROUP BY 1) USING (day)",
    "regime_of_date": f"SELECT regime, count(*) AS n FROM (SELECT CAST({_DAY} - INTERVAL 24 MONTH AS DATE) AS d FROM orders) JOIN {_REG} r(regime, lo, hi) ON d BETWEEN lo AND hi GROUP BY regime",
    "regime_segments": f"SELECT o_orderkey, regime, greatest(s, lo) AS segment_start, least(e, hi) AS segment_end FROM (SELECT o_orderkey, CAST({_DAY} - INTERVAL 24 MONTH AS DATE) AS s, CAST({_DAY} - INTERVAL 6 MONTH AS DATE) AS e FROM orders) JOIN {_REG} r(regime, lo, hi) ON s <= hi AND e >= lo",
    "asof_param": f"""WITH p(st, f, t, amount) AS (VALUES ('F', DATE '2024-01-01', DATE '2025-12-31', CAST(563 AS DOUBLE)), ('F', DATE '2025-01-01', NULL, 570), ('O', DATE '2024-06-01', DATE '2026-05-31', 451), ('O', DATE '2028-01-01', NULL, 471), ('P', DATE '2026-01-01', DATE '2026-12-31', 357)),
 o AS (SELECT o_orderkey, o_orderstatus, {_DAY} AS day FROM orders)
 SELECT o_orderkey, amount, f AS valid_from FROM o LEFT JOIN p ON st = o_orderstatus AND f <= day AND (t IS NULL OR t >= day) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY f DESC NULLS LAST) = 1""",
    "tariff_brackets": f"WITH i AS (SELECT o_orderkey, {_GROSS} AS gross, o_orderkey % 3 = 0 AS child FROM orders) SELECT o_orderkey, gross, CAST({_ALLOW} AS DECIMAL(18,2)) AS allowance, CAST({_OLD} AS DECIMAL(18,2)) AS old_allowance, CAST(CASE WHEN gross > 1000 THEN round((gross - 1000) * CAST(0.05 AS DECIMAL(5,4)), 2) ELSE 0 END AS DECIMAL(18,2)) AS \"offset\" FROM i",
    "need_reconcile": f"""WITH i AS (SELECT o_orderkey, {_GROSS} AS gross, o_orderkey % 3 = 0 AS child FROM orders), j AS (SELECT o_orderkey, CAST(gross * CAST(0.80 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS net, CAST({_ALLOW} AS DECIMAL(18,2)) AS allowance FROM i),
 k AS (SELECT *, greatest(CAST(0 AS DECIMAL(18,2)), net - allowance) AS income FROM j) SELECT o_orderkey, net, CAST(income AS DECIMAL(18,2)) AS income, CAST(greatest(CAST(0 AS DECIMAL(18,2)), CAST(1113 AS DECIMAL(18,2)) - income) AS DECIMAL(18,2)) AS claim FROM k""",
    "discrepancy_totals": """WITH d AS (SELECT l_orderkey, CAST((CAST(round(CAST(l_discount AS DECIMAL(4,2)) * 100) AS INTEGER) - 5) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS x FROM lineitem)
 SELECT l_orderkey, count(*) AS n_discrepancies, CAST(sum(x) AS DECIMAL(18,2)) AS total, CASE WHEN bool_and(x > 0) THEN 'zulasten' WHEN bool_and(x < 0) THEN 'zugunsten' ELSE 'gemischt' END AS direction FROM d WHERE abs(x) >= 0.02 GROUP BY l_orderkey""",
    "month_aggregate": """WITH s AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS label, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_right, CAST(sum(CAST(l_quantity - l_linenumber * 8 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_difference, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT *, CAST(sum(abs(sum_difference)) OVER (PARTITION BY month) AS DECIMAL(18,2)) AS month_abs FROM s""",
}
