"""Operators for large training corpora: search, duplicates, language, quality, mixing, shards."""
