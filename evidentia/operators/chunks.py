"""Chunks of documents with hierarchical paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, path, text) of every sentence, numbered from 1; null texts have none."""
    parts = docs.where("text IS NOT NULL").select("doc_id", "source", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    return parts.select("doc_id", (F.col("pos") + 1).alias("n"), F.concat_ws(" > ", "source", F.concat(F.lit("Satz "), (F.col("pos") + 1).cast("string"))).alias("path"), "text")


def section_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, label, text): guidance parted before lines that begin with a paragraph sign, before blanks are collapsed."""
    parts = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\\n(?=§\\s+[0-9]+)")).alias("pos", "text"))
    label = F.regexp_extract("text", "^(§\\s+[0-9]+[a-z]?)", 1)
    return parts.select("doc_id", (F.col("pos") + 1).alias("n"), F.when(label == "", F.lit("Allgemein")).otherwise(label).alias("label"), T.collapsed(F.col("text")).alias("text"))
