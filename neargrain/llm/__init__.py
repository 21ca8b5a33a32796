"""Operators of a training-data pipeline: archives, packing, deduplication, filtering, mixing.

Nothing else in the library imports this subpackage.
"""
