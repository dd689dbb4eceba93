"""Operators of a training-data pipeline over the ``documents`` table.

Nothing outside this subpackage imports it.
"""
