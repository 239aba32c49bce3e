"""Operators for training-data pipelines (sharding, mixing, tokenizing, quality, dedup, search, WARC).

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when the package can be imported.
"""
