"""Readers: history trees, summary tables, parameter documents, run collections."""
