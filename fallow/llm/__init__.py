"""Operators of a training-data pipeline, one module each; ``queries`` applies them to the given tables.

Nothing else in the library imports this subpackage.
"""
