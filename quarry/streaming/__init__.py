"""Structured Streaming forms of the batch operators.

The pipeline has no stream of its own; its one incremental behaviour is that
metrics are recomputed whenever new prediction files land. ``predictions``
keeps the per-run confusion counts as streaming state instead.
"""
