"""Training-data operators: cleaning, deduplication, scoring and packing of text corpora."""
