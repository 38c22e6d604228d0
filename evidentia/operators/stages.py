"""Which stages of an analysis must run again when some of them have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.tables import values

# Which stage directly feeds which.
FEEDS = (
    ("normalization", "classification"),
    ("normalization", "decomposition"),
    ("classification", "retrieval"),
    ("decomposition", "retrieval"),
    ("retrieval", "construction"),
    ("construction", "verification"),
    ("construction", "generation"),
    ("verification", "adversarial_review"),
    ("adversarial_review", "calculation_check"),
)


def closure(spark: SparkSession, feeds: DataFrame) -> DataFrame:
    """(stage, later, steps, cyclic) of all that a stage feeds, directly or not, by the fewest steps.

    Meant for a table of stages, a few dozen rows. A walk stops where it meets a stage again, so cycles end; a stage
    that feeds itself in the end is told as cyclic, and so is all that such a stage feeds.
    """
    found = spark.sql(
        """WITH RECURSIVE walk AS (
        SELECT stage, later, array(stage, later) AS path, 1 AS steps FROM {feeds} WHERE stage IS NOT NULL AND later IS NOT NULL
        UNION ALL
        SELECT w.stage, f.later, array_append(w.path, f.later), w.steps + 1 FROM walk w JOIN {feeds} f ON w.later = f.stage
        WHERE NOT array_contains(slice(w.path, 2, size(w.path)), f.later) AND w.stage <> w.later
        ), shortest AS (SELECT stage, later, min(steps) AS steps FROM walk GROUP BY stage, later)
        SELECT s.stage, s.later, s.steps, c.stage IS NOT NULL AS cyclic FROM shortest s LEFT JOIN shortest c ON c.stage = c.later AND s.stage = c.stage""",
        feeds=feeds.distinct(),
    )
    return found


def to_rerun(changed: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """(case_id, stage, steps, cyclic): for changed (case_id, stage) all stages that must run again, each once.

    A changed stage itself is told with 0 steps; a stage that several changed ones feed, with the fewest. The closure
    is worked out once over the stages and meets the cases in one join.
    """
    spark = changed.sparkSession
    known = closure(spark, feeds if feeds is not None else values(spark, list(FEEDS), "stage string, later string"))
    at = changed.where("case_id IS NOT NULL AND stage IS NOT NULL").select("case_id", "stage").distinct()
    after = at.join(known, "stage").select("case_id", F.col("later").alias("stage"), "steps", "cyclic")
    own = at.select("case_id", "stage", F.lit(0).alias("steps"), F.lit(False).alias("cyclic"))
    return own.unionByName(after).groupBy("case_id", "stage").agg(F.min("steps").alias("steps"), F.max("cyclic").alias("cyclic"))
