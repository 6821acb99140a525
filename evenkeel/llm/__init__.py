"""Training-data operators: quality, near-duplicates, mixing, sharding, packing, scoring."""
