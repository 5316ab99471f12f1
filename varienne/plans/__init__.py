"""Compositions: whole analyses expressed as one or a few Spark plans."""
