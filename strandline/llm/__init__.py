"""Operators for training-data pipelines: dedup, filtering, tokenising, packing, search.

Self-contained: nothing else in the library imports this subpackage.
"""
