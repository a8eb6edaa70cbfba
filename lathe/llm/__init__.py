"""Training-data operators: filtering, deduplication, encoding, packing, search and scoring."""
