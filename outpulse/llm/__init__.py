"""Operators of a training-data pipeline: deduplication, filtering, archives, token counts and packing."""
