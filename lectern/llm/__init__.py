"""Training-data operators: quality, near-duplicates, extraction, token output, packing, toxicity."""
