"""Operators of a training-data pipeline: filtering, deduplication, packing and output.

Nothing else in the library imports this package. Each module holds one operator;
``catalog`` registers a query for each over the whole given tables.
"""
