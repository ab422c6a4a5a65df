"""Operators on text collections: mixing, sharding, duplicates, token counts, quality, contamination, personal data."""
