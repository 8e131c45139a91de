"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; `queries.py` registers
its operators for the entry file.
"""
