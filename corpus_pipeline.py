"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark leaks go,
sources are mixed to target weights, and what is left is written as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import common, decontamination, jaccard, mixing, tokens, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut-off; the model learns from the labels of the input's tables."""
    return toxicity.scored(docs, toxicity.trained(spark, sf_dir), keep_below=toxicity.CUTOFF)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8, the one with the least id."""
    return jaccard.representatives(docs, words=5, threshold=0.8)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's share of the mix asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of every document begin and how many they are, read back from the written codes."""
    import public_tokenizers

    return tokens.read_documents(tokens.encode(docs, public_tokenizers.path("word_bpe_49k.json"), 1))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("token_ids", encoded),
]

#: No SQL: the classifier, the set join and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over all that the one before has kept, written and read again."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), name)
        if before:
            common.drop(before)
        before = docs
    return docs
