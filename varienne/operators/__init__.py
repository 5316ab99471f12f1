"""Operators: DataFrame to DataFrame transformations."""
