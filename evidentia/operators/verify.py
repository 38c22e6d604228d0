"""Quotes held against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import contains

#: Confidence that a claim may keep when its quote is not found, or its chunk is unknown.
CAP_NOT_FOUND, CAP_NO_CHUNK = 0.45, 0.35
#: Words of the longest quotes that are looked for by single words.
LEAD = 3


def _words(text: Column) -> Column:
    """The words of a text as T.contained compares it most loosely: collapsed, lower case, without hyphens."""
    return F.split(F.replace(F.lower(T.collapsed(text)), F.lit("-"), F.lit("")), " ")


def quotes_in(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, status) of every quote (item_id, text) that stands in a document.

    Words within a quote stand whole in its source; the first may end and the last begin a longer word. So
    the words within a quote meet the documents' by a hash (`contains.word_runs`), and the second of three by itself. A
    quote of one or two words meets the distinct words of all documents that hold its only word or begin
    with its second. Only documents found so are compared with the quote in full.
    """
    held = quotes.where("text IS NOT NULL").select("item_id", F.col("text").alias("quote"), _words(F.col("text")).alias("w"))
    worded = docs.where("text IS NOT NULL").select("doc_id", _words(F.col("text")).alias("w"))
    pairs = contains.word_runs(held.where(F.size("w") > LEAD), worded.withColumnRenamed("doc_id", "id")).select("item_id", F.col("id").alias("doc_id"), "quote")
    short = held.where(F.size("w") <= LEAD)
    if not short.isEmpty():
        single = worded.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
        three = short.where(F.size("w") == 3).select("item_id", "quote", F.get("w", F.lit(1)).alias("word"))
        few = short.where(F.size("w") < 3).select("item_id", "quote", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(1)).alias("second"))
        starts = single.select("word").distinct().join(F.broadcast(few), F.when(F.col("second").isNull(), F.contains("word", "first")).otherwise(F.startswith("word", "second")))
        keyed = three.unionByName(starts.select("item_id", "quote", "word"))
        pairs = pairs.unionByName(single.join(keyed, "word").select("item_id", "doc_id", "quote")).distinct()
    found = pairs.join(docs.select("doc_id", "text"), "doc_id")
    # A filter on the status would tell it once more for each pair; an empty list has no row.
    known = F.filter(F.array(T.contained(F.col("quote"), F.col("text"))), lambda s: s.isNotNull())
    return found.select("item_id", "doc_id", F.explode(known).alias("status"))


def verified(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds status and capped confidence to claims (claim_id, confidence, chunk_id, quote) against chunks (chunk_id, text)."""
    out = claims.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    status = F.coalesce(T.contained(F.col("quote"), F.col("text")), F.lit("unverifiziert"))
    cap = F.when(F.col("chunk_id").isNotNull() & F.col("text").isNull(), F.lit(CAP_NO_CHUNK)).when(F.col("status") == "unverifiziert", F.lit(CAP_NOT_FOUND)).otherwise(F.lit(1.0))
    return out.withColumn("status", status).withColumn("confidence", F.least("confidence", cap)).drop("text")
