"""Batches that come twice, stop half-way or belong to another query."""

import pytest
from pyspark.errors import StreamingQueryException

from evidentia.streaming import commits

SCHEMA = "case_id long, status string, stages array<struct<name string, millis long>>, claims array<struct<claim_id long, text string, bindings array<struct<chunk_id long, strength double>>>>, areas array<string>, batch string"
ONE = [(1, "completed", [("a", 5), ("b", 7)], [(10, "x", [(100, 0.9), (101, 0.2)]), (11, "y", [])], ["miete", "erbe", "miete"], "-")]
TWO = [(2, "failed", None, None, [], "-"), (3, "completed", [("a", 1)], [(12, None, None)], ["erbe"], "-")]


def rows(spark, folder, table):
    return sorted((tuple(r) for r in commits.committed(spark, folder, table).drop("batch_id").collect()), key=repr)


EXPECTED = {
    "cases": [(1, "completed"), (2, "failed"), (3, "completed")],
    "stages": [(1, 0, "a", 5), (1, 1, "b", 7), (3, 0, "a", 1)],
    "claims": [(1, 0, 10, "x", 2), (1, 1, 11, "y", 0), (3, 0, 12, None, 0)],
    "bindings": [(1, 10, 0, 100, 0.9), (1, 10, 1, 101, 0.2)],
    "areas": [(1, 0, "miete", True), (1, 1, "erbe", False), (3, 0, "erbe", True)],
}


def test_replayed_batches_leave_equal_tables(spark, tmp_path):
    folder = str(tmp_path / "out")
    batches = [spark.createDataFrame(b, SCHEMA) for b in (ONE, TWO)]
    for _ in range(2):
        wrote = [commits.write_batch(b, i, folder, "q", commits.CASE_TABLES) for i, b in enumerate(batches)]
        assert {t: rows(spark, folder, t) for t in commits.CASE_TABLES} == EXPECTED
    assert wrote == [False, False]


def test_half_a_batch_is_not_seen_and_is_mended(spark, tmp_path):
    folder, failing = str(tmp_path / "out"), dict(commits.CASE_TABLES)
    commits.write_batch(spark.createDataFrame(ONE, SCHEMA), 0, folder, "q", commits.CASE_TABLES)
    before = {t: rows(spark, folder, t) for t in commits.CASE_TABLES}

    def fails(cases):
        raise RuntimeError("lost")

    failing["bindings"] = fails
    with pytest.raises(RuntimeError):
        commits.write_batch(spark.createDataFrame(TWO, SCHEMA), 1, folder, "q", failing)
    assert {t: rows(spark, folder, t) for t in commits.CASE_TABLES} == before
    assert commits.write_batch(spark.createDataFrame(TWO, SCHEMA), 1, folder, "q", commits.CASE_TABLES)
    assert {t: rows(spark, folder, t) for t in commits.CASE_TABLES} == EXPECTED


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source + "/*")
    for i, part in enumerate((ONE, TWO)):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{source}/{i}")
        query = commits.fanned_out(stream(), folder, "q", commits.CASE_TABLES).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
    assert {t: rows(spark, folder, t) for t in commits.CASE_TABLES} == EXPECTED
    assert sorted(r.n_rows for r in commits.records(spark, folder).where("table = 'cases'").collect()) == [1, 2]
    spark.createDataFrame(ONE, SCHEMA).write.parquet(f"{source}/3")
    other = commits.fanned_out(stream(), folder, "another", commits.CASE_TABLES).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        other.awaitTermination(90)


def test_tasks_of_cases_grow_in_number_and_not_in_size(spark, monkeypatch):
    """Cached cases are dealt out by their number, whatever their size in a shuffle is; the rows stay the same."""
    from evidentia.plans import stream_queries

    few = stream_queries.case_fan_out(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(stream_queries, "PART_ROWS", 500, raising=False)
    many = stream_queries.case_fan_out(spark, "/root/testdata/sf0.001")
    assert len([f for f in many.inputFiles() if "/stages/" in f]) >= 12
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
