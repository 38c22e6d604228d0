"""Character budgets over ordered messages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept(rows: DataFrame, by: str, order: list, budget: int, text: str = "text", least: int = 100) -> DataFrame:
    """Rows in order while their texts fit the budget; adds kept_chars.

    The first row that does not fit is cut where more than `least` characters remain; the first row of all
    is always kept, cut to the budget.
    """
    window = Window.partitionBy(by).orderBy(*order)
    size = F.coalesce(F.length(text), F.lit(0))
    out = rows.withColumns({"_upto": F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(window), "_size": size})
    rest = F.lit(budget) - (F.col("_upto") - F.col("_size"))
    chars = F.when(F.col("_upto") <= budget, F.col("_size")).when((F.col("_n") == 1) | (rest > least), F.greatest(F.lit(0), rest))
    return out.withColumn("kept_chars", chars.cast("long")).where("kept_chars IS NOT NULL").drop("_upto", "_n", "_size")
