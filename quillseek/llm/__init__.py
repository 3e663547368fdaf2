"""Operators of a training-data pipeline: ten self-contained modules.

Nothing else in the library imports this subpackage.
"""
