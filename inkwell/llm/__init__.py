"""Training-data operators: deduplication, language ID, quality, mixing, packing and the like."""
