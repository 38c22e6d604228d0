"""Known values, and properties that SQL does not express."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates, money, pii
from evidentia.functions import text as T
from evidentia.operators import budget, evaluation, metrics, retrieval, tables, verify
from evidentia.sources import html
from evidentia.streaming import stateful

D = dt.date.fromisoformat


@pytest.mark.parametrize(
    "posted, state, receipt, end, rolled",
    [("2026-07-06", "NW", "2026-07-10", "2026-08-10", False), ("2026-06-15", "NW", "2026-06-19", "2026-07-20", True), ("2026-06-08", "NW", "2026-06-12", "2026-07-13", True), ("2026-06-18", "NW", "2026-06-22", "2026-07-22", False), ("2025-12-02", "BW", "2025-12-06", "2026-01-07", True)],
)
def test_deadline(spark, posted, state, receipt, end, rolled):
    rows = spark.createDataFrame([(D(posted), D(posted), None, "korrekt", True, state)], "dated date, posted date, received_on date, instruction string, is_act boolean, state string")
    got = dates.deadlines(rows, dates.calendar(spark, "2025-01-01", "2027-12-31")).first()
    assert (got.received, got.deadline, got.rolled_over, got.kind) == (D(receipt), D(end), rolled, "monat")


def test_letter_that_is_no_act(spark):
    rows = spark.createDataFrame([(D("2026-06-29"), None, None, "fehlt", False, "NW")], "dated date, posted date, received_on date, instruction string, is_act boolean, state string")
    got = dates.deadlines(rows, dates.calendar(spark, "2025-01-01", "2027-12-31", ("NW",))).first()
    assert (got.kind, got.deadline, got.disputed) == ("kein_va", D("2026-06-29"), False)


@pytest.mark.parametrize("gross, child, expected", [("300.00", False, "140.00"), ("520", False, "184.00"), ("1000", False, "328.00"), ("1200", False, "348.00"), ("1500", True, "378.00"), ("2000", False, "348.00"), ("0", False, "0.00")])
def test_allowance(spark, gross, child, expected):
    row = spark.range(1).select(money.allowance(F.lit(gross).cast("decimal(18,2)"), F.lit(child)).alias("a")).first()
    assert row.a == Decimal(expected)


def test_need(spark):
    row = money.reconciled(spark.sql("SELECT cast(890 AS decimal(18,2)) AS net, cast(338 AS decimal(18,2)) AS allowance, cast(1113 AS decimal(18,2)) AS need")).first()
    assert (row.income, row.claim) == (Decimal("552.00"), Decimal("561.00"))


def test_regimes(spark):
    days = spark.createDataFrame([(D(x),) for x in ("2023-06-30", "2023-07-01", "2025-01-01", "2026-07-01")], "d date")
    assert [r[0] for r in days.select(dates.regime_of(F.col("d"))).collect()] == ["a.F._vor_2023", "a.F._2023", "a.F._2025", "n.F._2026"]
    cut = dates.regime_segments(spark.createDataFrame([(1, D("2026-05-01"), D("2026-08-31"))], "id int, start date, end date")).orderBy("segment_start").collect()
    assert [(r.segment_start, r.segment_end) for r in cut] == [(D("2026-05-01"), D("2026-06-30")), (D("2026-07-01"), D("2026-08-31"))]


def test_fusion(spark):
    one = spark.createDataFrame([(1, 7, 1)], "query_id long, chunk_id long, rank int")
    row = retrieval.fuse(one, one.limit(0)).first()
    assert abs(row.score - 1 / 61) < 1e-9


def test_cosine(spark):
    row = spark.range(1).select(*[retrieval.cosine_distance(F.lit([1.0, 0.0]), F.lit(v)).alias(n) for n, v in (("same", [2.0, 0.0]), ("across", [0.0, 3.0]), ("none", [0.0, 0.0]))]).first()
    assert abs(row.same) < 1e-9 and abs(row.across - 1) < 1e-9 and row.none is None


def test_zero_and_empty_vectors_match_nothing(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, []), (3, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    got = retrieval.vector_search(rows.withColumnRenamed("chunk_id", "query_id"), rows, k=5).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(0, 3), (3, 0)}


def test_masking_gives_the_text_back(spark):
    text = "Herr Karl Meier, 12345//1234567, karl@example.org und karl@example.org, +49 151 1234567 [[X]]"
    out, mapping = pii.mask_text(text)
    assert pii.unmask_text(out, mapping) == text
    assert "karl@example.org" not in out and out.count("[[EMAIL_1]]") == 2 and "12345//" not in out and "151" not in out
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.masked(rows).collect()}
    assert got[1].restored == text and got[2].masked == "" and got[3].mapping == {}


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("IBAN", "DE89 3704 0044 0532 0130 00"), ("IBAN", "DE89370400440532013000"), ("BG_NUMMER", "12345 // 1234567"), ("BG_NUMMER", "12345/1234567"),
        ("SV_NUMMER", "65 170839 J 008"), ("SV_NUMMER", "65170839J008"), ("EMAIL", "a.b+c@mail.example-x.org"), ("STEUER_ID", "12 345 678 901"), ("STEUER_ID", "12345678901"),
        ("TELEFON", "+49 151 1234567"), ("TELEFON", "030/123 456-78"), ("TELEFON", "0221-1234567"), ("TELEFON", "+49 (0)30 123456"), ("TELEFON", "0049 30 1234567"), ("TELEFON", "+4915112345678"),
    ],
)
def test_detectors_by_public_formats(kind, value):
    masked, mapping = pii.mask_text(f"Siehe {value}, danke.")
    assert mapping == {f"[[{kind}_1]]": value} and masked == f"Siehe [[{kind}_1]], danke."


@pytest.mark.parametrize("text", ["§ 11b SGB II", "am 01.02.2024 um 08:30", "1234 Euro 56", "DE12", "a@b", "12345/12", "0,50 Euro und 007"])
def test_detectors_leave_other_numbers_alone(text):
    assert pii.mask_text(text) == (text, {})


def test_easter():
    published = ["1943-04-25", "1954-04-18", "1961-04-02", "1981-04-19", "2000-04-23", "2008-03-23", "2024-03-31", "2025-04-20", "2026-04-05", "2027-03-28", "2038-04-25", "2049-04-18", "2076-04-19"]
    assert [dates.easter(int(d[:4])).isoformat() for d in published] == published


def test_norms(spark):
    row = spark.range(1).select(T.norm_references(F.lit("§ 11b Abs. 1 SGB II n.F. und §§ 45/48 SGB X, § 1 XYZ")).alias("n")).first()
    assert row.n == ["§ 11b SGB II", "§ 45 SGB X", "§ 48 SGB X"]


def test_quotes(spark):
    chunk = spark.createDataFrame([("c1", "Der Regel-\nbedarf wird   anerkannt.")], "chunk_id string, text string")
    claims = spark.createDataFrame([(1, 0.9, "c1", "wird anerkannt"), (2, 0.9, "c1", "fehlt"), (3, 0.9, "cx", "x"), (4, 0.9, None, "x")], "claim_id int, confidence double, chunk_id string, quote string")
    got = {r.claim_id: (r.status, r.confidence) for r in verify.verified(claims, chunk).collect()}
    assert got == {1: ("normalisiert", 0.9), 2: ("unverifiziert", 0.45), 3: ("unverifiziert", 0.35), 4: ("unverifiziert", 0.45)}


def test_budget_keeps_the_first_and_cuts_one(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 700), (2, 1, "b" * 300), (2, 2, "c" * 400), (2, 3, "d")], "id int, n int, text string")
    got = {(r.id, r.n): r.kept_chars for r in budget.kept(rows, "id", ["n"], 600).collect()}
    assert got == {(1, 1): 600, (2, 1): 300, (2, 2): 300}


def test_gate_knows_which_way_is_worse(spark):
    a = spark.createDataFrame([("x", "leakage", 0.0), ("x", "recall", 0.9), ("y", "deadline", 1.0)], "case_id string, metric string, value double")
    b = spark.createDataFrame([("x", "leakage", 1.0), ("x", "recall", 0.5), ("z", "deadline", 1.0)], "case_id string, metric string, value double")
    assert {(r.case_id, r.metric): r.outcome for r in metrics.gate(a, b).collect()} == {("x", "leakage"): "fail", ("x", "recall"): "warn", ("y", "deadline"): "fail", ("z", "deadline"): "new"}


def test_upsert_twice_changes_nothing(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, t int")
    once = tables.upserted(now, new, ["k"], ["t"])
    assert sorted(once.collect()) == sorted(tables.upserted(once, new, ["k"], ["t"]).collect())


def test_html(spark):
    pages = spark.createDataFrame([(1, "<div>a <b>b</b><p>c</p><script>x</script></div>"), (2, None), (3, "")], "page_id long, html string")
    assert [(r.page_id, r.n, r.text) for r in html.blocks(pages).orderBy("page_id", "n").collect()] == [(1, 1, "a b"), (1, 2, "c")]


def test_html_of_any_ids(spark):
    rows = spark.createDataFrame([(None, "<p>a<p>b"), (9007199254740993, "c"), (1, None), (2, "")], "page_id long, html string").coalesce(1)
    assert [tuple(r) for r in html.blocks(rows).collect()] == [(None, 1, "a"), (None, 2, "b"), (9007199254740993, 1, "c")]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, base + dt.timedelta(minutes=7 * i)) for i in range(120)]
    frame = spark.createDataFrame(rows, "event_id long, client long, ts timestamp")
    frame.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r.event_id: r.admitted for r in stateful.rate_limited(frame, 3, 3600).collect()}
    recent, expected = {}, {}
    for e, c, t in rows:
        kept = [x for x in recent.get(c, []) if x > t - dt.timedelta(hours=1)]
        expected[e] = len(kept) < 3
        recent[c] = [*kept, t] if expected[e] else kept
    assert batch == expected
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = stateful.rate_limited_stream(stream, 3, 3600).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert {r.event_id: r.admitted for r in spark.table("admitted").collect()} == expected


def test_hourly_stream(spark, tmp_path):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5), "view", 1.0) for h in (0, 0, 1, 9)], "ts timestamp, event_type string, value double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = stateful.hourly_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 1, 2]


def test_quotes_of_any_length_and_with_hyphens(spark):
    texts = ["The Anspruch be-steht nach dem Gesetz fort", "der Anspruch besteht nach dem Gesetz", "Mietvertrag", "ein Miet-vertrag gilt, so", "gilt", "", "Es - gilt  nicht"]
    quotes = ["Anspruch besteht nach dem Gesetz", "nach dem Gesetz", "vertrag gilt", "Mietvertrag", "ilt", "Anspruch be-steht nach dem", "es gilt nicht", "Anspruch besteht morgen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in verify.quotes_in(items, docs).collect())
    bare = lambda t: re.sub(r"\s+", " ", t).strip().lower().replace("-", "")
    assert got == [(i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if bare(q) in bare(t)]


def test_rate_limit_of_nulls_and_large_ids(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(9007199254740993 + i, c, at, "x") for i, c in enumerate([None, None, None, 9007199254740993, 1])] + [(5, 1, None, "x")]
    got = {(r.event_id, r.client): r.admitted for r in stateful.rate_limited(spark.createDataFrame(rows, "event_id long, client long, ts timestamp, admitted string"), 2, 60).collect()}
    assert got == {(9007199254740993, None): True, (9007199254740994, None): True, (9007199254740995, None): False, (9007199254740996, 9007199254740993): True, (9007199254740997, 1): True, (5, 1): False}


def test_edit_to_null_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    edits = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (3, 1, "y")], "k int, at int, v string")
    assert sorted(tuple(r) for r in evaluation.edited(rows, edits, "k", "v").select("k", "v", "n_edits").collect()) == [(1, None, 2), (2, "b", 0), (3, "y", 1)]
