"""Operators that prepare training data: splitting, near-duplicates, neighbours, clusters, repair, packing, mixing, sentences."""
