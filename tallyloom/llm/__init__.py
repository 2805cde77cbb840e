"""Training-data operators: deduplication, filtering, extraction, formatting and mixing of text corpora."""
