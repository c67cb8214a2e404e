"""Operators that prepare training data: extraction, deduplication, quality, mixing, sharding, packing."""
