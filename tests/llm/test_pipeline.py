"""The pipeline's stages, each on what the one before has kept."""

import corpus_pipeline
from evidentia.llm import common, decontamination, jaccard

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.save(stage(spark, docs, SF), name)
        kept[name] = docs
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").isEmpty()
    again = jaccard.near_duplicates(kept["near_duplicates"], 5, 0.8)
    assert again.where("doc_id <> component_id").isEmpty()
    assert decontamination.matches(kept["decontamination"], common.table(spark, SF, "benchmark")).isEmpty()
    assert kept["mixing"].columns == kept["decontamination"].columns
    assert kept["token_ids"].count() == kept["mixing"].count() > 0
    assert corpus_pipeline.run(spark, SF).count() == kept["token_ids"].count()
