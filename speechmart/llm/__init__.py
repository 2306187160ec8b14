"""Operators for large training-data pipelines: search, tokenizing, scans, packing, sharding, dedup.

Nothing outside this subpackage imports it.
"""
