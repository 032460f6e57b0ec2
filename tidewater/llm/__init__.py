"""Training-data operators: tokenising, archiving, deduplication, filtering, sharding."""
