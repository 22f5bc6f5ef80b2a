"""Training-data operators: tokenising, filtering, deduplicating and archiving text at scale."""
