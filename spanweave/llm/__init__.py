"""Operators for large-scale training-data pipelines (optional subpackage).

Nothing else in the library imports this package.
"""
