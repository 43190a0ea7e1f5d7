"""Operators for preparing training corpora: scoring, filtering, fingerprints,
near-duplicate removal, mixing, sharding and packing.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
