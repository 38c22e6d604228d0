"""Evaluation metrics and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics and whether a change for the worse fails the gate or only warns; for leakage less is better.
STRICT, WARN, LESS_IS_BETTER = ("calculation", "deadline", "quote_rate", "leakage"), ("recall", "precision", "assessment"), ("leakage",)


def precision(found: Column, expected: Column) -> Column:
    """Share of what was found that was expected; 1 where both are empty."""
    both = F.size(F.array_intersect(found, expected))
    return F.when((F.size(found) == 0) & (F.size(expected) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(found), F.lit(1)))


def recall(found: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))


def rates(rows: DataFrame, by: list[str], truth: str, said: str) -> DataFrame:
    """Precision, recall and F1 of a 0/1 verdict per group; a rate without cases is null."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, s = F.col(truth) == 1, F.col(said) == 1
    sums = rows.groupBy(*by).agg(count(t & s).alias("tp"), count(~t & s).alias("fp"), count(t & ~s).alias("fn"))
    ratio = lambda a, b: F.round(F.col("tp") / F.nullif(a + b, F.lit(0)), 6)
    return sums.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})


def gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(case_id, metric, before, after, outcome) of two reports (case_id, metric, value).

    A case or metric that is missing now fails; one that is new passes. A change for the worse fails for
    strict metrics and warns for others, whichever direction is worse for the metric.
    """
    joined = baseline.select("case_id", "metric", F.col("value").alias("before"), F.lit(1).alias("_b")).join(current.select("case_id", "metric", F.col("value").alias("after"), F.lit(1).alias("_c")), ["case_id", "metric"], "full_outer")
    worse = F.when(F.col("metric").isin(*LESS_IS_BETTER), F.col("after") > F.col("before")).otherwise(F.col("after") < F.col("before"))
    lost = F.col("_c").isNull() | (F.col("before").isNotNull() & F.col("after").isNull())
    bad = F.when(F.col("metric").isin(*STRICT), F.lit("fail")).otherwise(F.lit("warn"))
    outcome = F.when(F.col("_b").isNull(), F.lit("new")).when(F.col("_c").isNull(), F.lit("fail")).when(lost | F.coalesce(worse, F.lit(False)), bad).otherwise(F.lit("pass"))
    return joined.select("case_id", "metric", "before", "after", outcome.alias("outcome"))


def issue_recall(expected: list[list[str]], found: list[list[str]]) -> float:
    """Share of expected issues that a found one meets, each used once, in order; sets of citations meet if they overlap."""
    if not expected:
        return 1.0
    left, hit = [set(f) for f in found], 0
    for e in expected:
        k = next((i for i, f in enumerate(left) if f & set(e)), None)
        if k is not None:
            hit += 1
            left.pop(k)
    return hit / len(expected)


def exact_matches(expected: DataFrame, actual: DataFrame, by: str, tolerance: float = 0.005) -> DataFrame:
    """Per case the share of expected numbers (by, key, value) that the actual ones meet; text is skipped, and a case without numbers scores 1."""
    e = expected.withColumn("want", F.col("value").try_cast("double")).drop("value")
    a = actual.withColumn("got", F.col("value").try_cast("double")).drop("value")
    met = F.when(F.col("want").isNotNull(), F.when(F.abs(F.col("want") - F.col("got")) <= tolerance, 1.0).otherwise(0.0))
    return e.join(a, [by, "key"], "left").groupBy(by).agg(F.coalesce(F.round(F.avg(met), 6), F.lit(1.0)).alias("exact_match"), F.count("want").alias("n"))
