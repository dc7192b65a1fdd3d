"""Operators of a training-data pipeline: filtering, deduplication, mixing and packing."""
