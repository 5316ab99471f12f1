"""Saved results and manifests as Parquet tables and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def export_results(root: str, indices: DataFrame, coefs: DataFrame, summary: DataFrame | None = None, partitions: Sequence[str] = ("strategy", "group_value")) -> None:
    """Indices and surrogates partitioned by strategy and group, and the nested summary as JSON.

    Rows are clustered by the partition columns first, so every directory gets few files.
    """
    for name, df in (("indices", indices), ("surrogate", coefs)):
        df.repartition(*[F.col(p) for p in partitions], F.pmod(F.xxhash64("output_id"), F.lit(8))).write.partitionBy(*partitions).parquet(f"{root}/{name}")
    if summary is not None:
        summary.write.json(f"{root}/summary")


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read
    return reader.json(f"{root}/{name}") if name == "summary" else reader.parquet(f"{root}/{name}")


def row_digest(columns: Sequence[str], digest: str = "xxhash64") -> Column:
    if digest == "xxhash64":
        return F.xxhash64(*columns).cast("decimal(38,0)")
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("decimal(38,0)")


def table_hash(df: DataFrame, columns: Sequence[str] | None = None, digest: str = "xxhash64") -> DataFrame:
    """Order-independent fingerprint: rows and the sum of row digests, combined map-side."""
    columns = list(columns or df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(row_digest(columns, digest)), F.lit(0).cast("decimal(38,0)")).cast("string").alias("data_hash"))


def manifest(tables: dict[str, DataFrame], digest: str = "xxhash64", columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per table: name, columns, row count and fingerprint."""
    out = None
    for name, df in tables.items():
        used = list((columns or {}).get(name, df.columns))
        row = table_hash(df, used, digest).select(F.lit(name).alias("table_name"), F.lit(",".join(used)).alias("columns"), "n_rows", "data_hash")
        out = row if out is None else out.unionByName(row)
    return out


def latex_rows(table: DataFrame, name: str, values: Sequence[str], order: str, digits: int = 3) -> DataFrame:
    """Table rows as LaTeX lines with a position; NaN prints as a dash."""
    cells = [F.when(F.isnan(v) | F.col(v).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(v))) for v in values]
    label = F.replace(F.col(name), F.lit("_"), F.lit("\\_"))
    return table.select(F.col(order), F.concat(F.concat_ws(" & ", label, *cells), F.lit(" \\\\")).alias("line"))


def export_table(table: DataFrame, path: str, fmt: str, name: str, values: Sequence[str], order: str) -> None:
    """Write a top-k report as CSV or as LaTeX lines, in one file (k rows)."""
    if fmt == "csv":
        table.coalesce(1).write.option("header", "true").csv(path)
    elif fmt == "latex":
        latex_rows(table, name, values, order).orderBy(order).coalesce(1).select("line").write.text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}, expected 'csv' or 'latex'")
