"""Operators of a training-data pipeline: filters, duplicates, pseudonyms, extraction, mixing, shards."""
