"""Training-data operators: mixing, token output, quality, scoring, dedup, tokenising and privacy."""
