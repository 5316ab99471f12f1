"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.session import materialize


def renamed(docs: DataFrame, *columns: str, to: tuple[str, ...] | None = None) -> DataFrame:
    """Only the named columns, so that others, however named, cannot clash."""
    return docs.select(*[F.col(f"`{c}`").alias(t) for c, t in zip(columns, to or columns)])


def total_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts; one pass that reads a single column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("bigint"))).first()[0] or 0)


__all__ = ["materialize", "renamed", "total_bytes"]
