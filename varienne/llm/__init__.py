"""Operators of a training-data pipeline.

One module per operator; ``queries`` registers them over the provided tables.  Nothing
outside this subpackage imports it.
"""
