"""Training-data operators: tokens, quality, near-duplicates, search and packing."""
