"""Structured Streaming jobs over histories that are still growing."""
