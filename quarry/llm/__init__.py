"""Operators of a training-data pipeline: quality, dedup, sharding, packing,
tokenisation, privacy and secrets. Nothing else in the library imports this
subpackage."""
