"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the query registry adds it only when it is present.
"""
