"""Files as rows: bytes to text, kinds of uploads, JSON reports, and audits of expectation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uploads beyond this many bytes are refused.
MOST_BYTES = 25 * 1024 * 1024


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(data, "ISO-8859-1"))


def upload_kind(content_type: Column, size: Column) -> Column:
    """How an upload is read: pdf, text or image; what is too large or of another type is refused."""
    return (
        F.when(size > MOST_BYTES, F.lit("zu_gross"))
        .when(content_type == "application/pdf", F.lit("pdf"))
        .when(content_type.startswith("text/") | (content_type == "message/rfc822"), F.lit("text"))
        .when(content_type.startswith("image/"), F.lit("image"))
        .otherwise(F.lit("unbekannt"))
    )


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports of a folder, latest first; files that are no report are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("goldset_version string, run_timestamp string, cases array<struct<case_id:string,metric:string,value:double>>").json(path)
    return rows.where("goldset_version IS NOT NULL AND run_timestamp IS NOT NULL AND cases IS NOT NULL").orderBy(F.desc("run_timestamp"))


def goldset_faults(cases: DataFrame) -> DataFrame:
    """(id, fault) of expectation cases (id, category, text, citations): doubled ids, gaps, citations unlike any."""
    repeated = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("id doppelt").alias("fault"))
    empty = cases.where("text IS NULL OR trim(text) = ''").select("id", F.lit("text leer").alias("fault"))
    none = cases.where("citations IS NULL OR size(citations) = 0").select("id", F.lit("ohne norm").alias("fault"))
    odd = cases.where("citations IS NOT NULL").select("id", F.explode("citations").alias("c")).where(~F.rlike("c", F.lit("^§§? [0-9]+"))).select("id", F.concat(F.lit("norm unklar: "), "c").alias("fault"))
    return repeated.unionByName(empty).unionByName(none).unionByName(odd)
