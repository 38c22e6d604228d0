"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import chat, decontamination, jaccard, licenses, merkle, mixing, quality, runs, secrets, sharding, sql, tokens, toxicity, warc

QUERIES = {
    "op1_token_ids": tokens.op1_token_ids,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_windows": chat.op3_chat_windows,
    "op4_entropy_mix": mixing.op4_entropy_mix,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_byte_shards": sharding.op7_byte_shards,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_benchmark_leaks": decontamination.op10_benchmark_leaks,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_warc_salvage": warc.op13_warc_salvage,
}

ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": sql.jaccard(), "op8_license_scan": sql.licenses(), "op11_merkle_manifest": sql.merkle(), "op13_warc_salvage": sql.warc()}
