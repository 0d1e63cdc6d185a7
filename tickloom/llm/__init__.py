"""Operators of a training-data pipeline, and their queries.

Nothing else in ``tickloom`` imports this subpackage.
"""
