"""Operators for preparing training data: counting, cleaning, deduplication, search, scoring and output of documents."""
