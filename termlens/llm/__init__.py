"""Operators of a training-data pipeline: scoring, mixing, filtering, deduplication, search, tokens.

Nothing outside this package imports it.
"""
