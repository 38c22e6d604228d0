"""Monetary rules in decimal arithmetic: bracketed allowances, needs, reconciliation and discrepancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds and rates of the allowance brackets, now and before July 2023, and the last
# bound where a minor child lives in the household.
BRACKETS = ((100, "1.00"), (520, "0.20"), (1000, "0.30"), (1200, "0.10"))
OLD_BRACKETS = ((100, "1.00"), (1000, "0.20"), (1200, "0.10"))
LAST_WITH_CHILD = 1500
#: Differences under this many euros are no discrepancy.
TOLERANCE = "0.02"

MONEY = "decimal(18,2)"


def _part(gross: Column, low: int, high: Column, rate: str) -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.round(F.greatest(zero, F.least(gross, high.cast(MONEY)) - F.lit(low).cast(MONEY)) * F.lit(rate).cast("decimal(5,4)"), 2).cast(MONEY)


def allowance(gross: Column, has_child: Column, old: bool = False) -> Column:
    """The sum of every bracket's rounded part of the gross income; the last bracket reaches further with a child."""
    low, out = 0, F.lit(0).cast(MONEY)
    table = OLD_BRACKETS if old else BRACKETS
    for i, (high, rate) in enumerate(table):
        bound = F.when(has_child, F.lit(LAST_WITH_CHILD)).otherwise(F.lit(high)) if i == len(table) - 1 else F.lit(high)
        out = out + _part(gross, low, bound, rate)
        low = high
    return out.cast(MONEY)


def reconciled(rows: DataFrame) -> DataFrame:
    """Adds income (net less allowance) and claim (need less income), neither under nothing."""
    zero = F.lit(0).cast(MONEY)
    out = rows.withColumn("income", F.greatest(zero, F.col("net") - F.col("allowance")).cast(MONEY))
    return out.withColumn("claim", F.greatest(zero, F.col("need") - F.col("income")).cast(MONEY))


def offset(base: Column, rate: str = "0.05") -> Column:
    """A share of the base, of nothing where the base is not positive."""
    return F.when(base > 0, F.round(base * F.lit(rate).cast("decimal(5,4)"), 2)).otherwise(F.lit(0)).cast(MONEY)


def direction(difference: Column) -> Column:
    """Whom a difference (right minus granted) burdens."""
    return F.when(F.abs(difference) < F.lit(TOLERANCE).cast("decimal(5,4)"), F.lit("keine")).when(difference > 0, F.lit("zulasten")).otherwise(F.lit("zugunsten"))


def totals(differences: DataFrame, by: list[str], difference: str = "difference") -> DataFrame:
    """Per group: discrepancies beyond the tolerance, their sum, and their direction, mixed ones named so."""
    way = direction(F.col(difference))
    counted = differences.where(way != "keine").withColumn("way", way)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_discrepancies"),
        F.sum(difference).cast(MONEY).alias("total"),
        F.when(F.bool_and(F.col("way") == "zulasten"), F.lit("zulasten")).when(F.bool_and(F.col("way") == "zugunsten"), F.lit("zugunsten")).otherwise(F.lit("gemischt")).alias("direction"),
    )
