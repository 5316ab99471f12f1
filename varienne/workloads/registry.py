"""Registry of queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.workloads.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under a name."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounding used on results that are compared across engines: of the double c * 10**digits, halves away from zero, as SQL's ``round`` has it.

    ``F.round`` with digits goes by the shortest decimal text of the double, which next to a half may lie on its other side.
    """
    scale = 10.0**digits
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, some to their own precision."""
    cols = []
    for field in df.schema:
        c = F.col(field.name)
        cols.append(rnd(c, special.get(field.name, digits)).alias(field.name) if field.dataType.simpleString() == "double" else c)
    return df.select(*cols)


def sr(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"
