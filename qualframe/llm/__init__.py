"""Operators for preparing training text: deduplication, tokens, labels, quality, packing and shards."""
