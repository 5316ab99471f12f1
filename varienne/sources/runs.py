"""Collections of run trees and saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: directory of one sample's tree, as single runs write it or as one partitioned write does.
SAMPLE_DIRECTORY = r"(?:uq_sample_(\d{4,})/history|uq_sample=(\d+))/"


def scan_run_trees(spark: SparkSession, root: str) -> DataFrame:
    """All sample trees in one scan; the sample id is read from the path."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pq,parquet}").parquet(root)
    sample = F.concat(*[F.regexp_extract(F.col("_metadata.file_path"), SAMPLE_DIRECTORY, i) for i in (1, 2)])
    return df.select(sample.try_cast("int").alias("sample_id"), "*").where(F.col("sample_id").isNotNull())


def collect_runs(trees: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Average every observable per sample and attach the sample's inputs."""
    means = trees.groupBy("sample_id").agg(*[F.avg(c).alias(c) for c in columns])
    return samples.join(means, "sample_id")


def missing_runs(trees: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples without a tree."""
    return samples.join(trees.select("sample_id").distinct(), "sample_id", "left_anti")


def require_runs(trees: DataFrame, samples: DataFrame) -> None:
    """Raise an error with the number of samples without a tree; ``missing_runs`` lists them all."""
    gone = missing_runs(trees, samples).select("sample_id")
    first = [r.sample_id for r in gone.take(20)]
    if first:
        raise FileNotFoundError(f"no history for {gone.count()} samples, among them {first}")


def count_completed(history: DataFrame, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Number of distinct variants that have data."""
    return history.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_completed"))
