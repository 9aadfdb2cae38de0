"""Operators for preparing training text: tokens, vectors, packing, filters, shards, media, duplicates."""
