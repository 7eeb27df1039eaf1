"""Training-data operators: archives, scoring, selection, deduplication, mixing and packing."""
