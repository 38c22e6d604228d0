"""Training-data operators: tokens, toxicity, chat windows, mixing, joins, scans, shards and rules."""
