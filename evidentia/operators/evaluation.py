"""Metrics of cases against a gold set: citations, verdicts, masked spans, and what claims may be used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength from which a binding counts as exact.
EXACT = 0.8


def binding_status(claims: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    """Adds verification to claims: exakt from a binding of EXACT or more, normalisiert from any, else unverifiziert."""
    best = bindings.groupBy(key).agg(F.max("strength").alias("_best"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("_best") >= EXACT, F.lit("exakt")).when(F.col("_n") > 0, F.lit("normalisiert")).otherwise(F.lit("unverifiziert"))
    return claims.join(best, key, "left").withColumn("verification", status).drop("_best", "_n")


def usable(verification: Column, adjudication: Column) -> Column:
    """Whether a claim may fill a slot: its quote was found and a person has confirmed it."""
    return F.coalesce(verification.isin("exakt", "normalisiert") & (adjudication == "confirmed"), F.lit(False))


def first_on_topic(claims: DataFrame, by: str, order: list[str], text: str, keywords: list[str]) -> DataFrame:
    """Per group the first claim, in order, that names one of the keywords."""
    named = F.lit(False)
    for k in keywords:
        named = named | F.contains(F.lower(text), F.lit(k))
    firsts = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return claims.where(named).withColumn("_n", firsts).where("_n = 1").drop("_n")


def greedy_recall(found: Column, expected: Column) -> Column:
    """Share of expected sets that a found one meets, each once: found sets in order take the first open one that
    shares an element. Nothing expected counts as 1."""
    size = F.size(expected)
    start = F.transform(expected, lambda e: F.lit(False))

    def step(taken: Column, f: Column) -> Column:
        fits = F.transform(expected, lambda e, i: F.arrays_overlap(e, f) & ~F.get(taken, i))
        first = F.array_position(fits, F.lit(True))
        return F.transform(taken, lambda t, i: t | (i + 1 == first))

    hit = F.size(F.filter(F.aggregate(found, start, step), lambda t: t))
    return F.when(size == 0, F.lit(1.0)).otherwise(hit / size)


def spans_hit(spans: DataFrame, others: DataFrame, key: str, cell: int = 256) -> DataFrame:
    """Rows of spans (key, start, end) that overlap one of the others, ends exclusive.

    Spans meet in cells of `cell` characters, so that the join is by equality and long lists are never crossed.
    """
    cells = lambda d: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / cell))))
    a, b = cells(spans).alias("a"), cells(others.select(key, "start", "end")).alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._cell") == F.col("b._cell")) & (F.col("a.end") > F.col("b.start")) & (F.col("a.start") < F.col("b.end")), "left_semi")
    return met.drop("_cell").distinct()


def adjacent_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Spans that begin before their predecessor ends without lying in it, the spans of a key in order."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = spans.withColumns({"before_start": F.lag("start").over(order), "before_end": F.lag("end").over(order)})
    return before.where("start < before_end AND end > before_end AND start > before_start")


def controls_lost(controls: Column, original: Column, masked: Column) -> Column:
    """How many strings that must survive masking stood in the original and do not stand in the masked text."""
    return F.size(F.filter(controls, lambda c: F.contains(original, c) & ~F.contains(masked, c)))


def edited(rows: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """rows with their value as the latest edit left it; edits (key, at, value) are only ever
    added; of two at one time the greater value counts. An edit to null leaves null."""
    last = edits.groupBy(key).agg(F.max(F.struct("at", value))[value].alias("_new"), F.count(F.lit(1)).alias("n_edits"))
    return rows.join(last, key, "left").withColumns({value: F.when(F.col("n_edits").isNull(), F.col(value)).otherwise(F.col("_new")), "n_edits": F.coalesce("n_edits", F.lit(0))}).drop("_new")


def deleted_parents(parents: DataFrame, gone: DataFrame, key: str, restricting: DataFrame, optional: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and optional children after a delete: parents that a restricting child names stay, and the optional
    children of those that go lose their key but stay themselves."""
    leaves = gone.select(key).distinct().join(restricting.select(key).distinct(), key, "left_anti")
    marked = optional.join(leaves.withColumn("_gone", F.lit(True)), key, "left")
    return parents.join(leaves, key, "left_anti"), marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*optional.columns)
