"""Training-data operators: dedup, sharding, tokenization, archives, decontamination, search, quality."""
