"""Training-data operators: quality, packing, archives, toxicity, joins, dedup, tokens."""
