"""Training-data operators: deduplication, filtering, mixing, scoring and fingerprints."""
