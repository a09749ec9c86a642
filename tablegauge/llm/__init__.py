"""Operators of a training-data pipeline: tokenising, cleaning, deduplication, formatting.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
