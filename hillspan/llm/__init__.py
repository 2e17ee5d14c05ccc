"""Operators of a training-data pipeline: deduplication, search, extraction, labelling, mixing and token output."""
