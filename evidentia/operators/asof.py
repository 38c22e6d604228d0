"""As-of lookups of versioned parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, versions: DataFrame, on: str, key: list[str], row_id: list[str]) -> DataFrame:
    """Every row with the version of its key that holds at the row's date, or nulls.

    versions has the key, valid_from, valid_to (null: open) and values. Of several that hold, the one with
    the latest start counts. The versions are a small dimension and are sent to all tasks; per row only the
    versions of its own key are looked at.
    """
    held = versions.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", *[c for c in versions.columns if c not in (*key, "valid_from", "valid_to")])), asc=False).alias("versions"))
    joined = rows.join(held, key, "left")
    fits = F.filter("versions", lambda v: (v["valid_from"] <= F.col(on)) & (v["valid_to"].isNull() | (v["valid_to"] >= F.col(on))))
    return joined.withColumn("version", F.get(fits, F.lit(0))).drop("versions")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
