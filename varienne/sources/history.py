"""History trees: hive-partitioned Parquet with one directory level per id."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id levels of a history tree and their types.
ID_TYPES = {
    "experiment_id": "string",
    "variant": "int",
    "lineage_seed": "int",
    "generation": "int",
    "agent_id": "string",
}
ID_COLUMNS = tuple(ID_TYPES)
METADATA_COLUMNS = (*ID_COLUMNS, "time")


def scan_history(
    spark: SparkSession,
    root: str,
    experiments: str | Sequence[str] | None = None,
    glob: str = "*.{pq,parquet}",
    merge_schema: bool = True,
) -> DataFrame:
    """Scan a history tree; the ids come from partition discovery.

    Columns that only some files have are null in the others; ``merge_schema=False`` saves the look
    at every footer where all files are known to agree.  Restricting to experiments narrows the listed paths, so other experiments are
    never listed.  Id types are cast explicitly instead of trusting inference.
    """
    if isinstance(experiments, str):
        experiments = [experiments]
    paths = [f"{root}/experiment_id={e}" for e in experiments] if experiments else [root]
    try:
        df = (
            spark.read.option("basePath", root)
            .option("pathGlobFilter", glob)
            .option("mergeSchema", str(merge_schema).lower())
            .parquet(*paths)
        )
    except Exception as err:
        if "UNABLE_TO_INFER_SCHEMA" in str(err) or "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(f"no Parquet files under {paths}") from err
        raise
    return df.withColumns({c: F.col(c).cast(t) for c, t in ID_TYPES.items() if c in df.columns})


def load_dataset(
    spark: SparkSession,
    root: str,
    experiments: str | Sequence[str],
    observables: Sequence[str] | None = None,
    include_metadata: bool = True,
) -> DataFrame:
    """One or many experiments, projected to the wanted columns that exist."""
    df = scan_history(spark, root, experiments)
    if observables is None:
        return df
    keep = [c for c in METADATA_COLUMNS if include_metadata and c in df.columns]
    return df.select(*keep, *[c for c in observables if c in df.columns and c not in keep])


def list_columns(df: DataFrame, pattern: str = "*") -> list[str]:
    """Column names that match a glob, read from the schema without a job."""
    return sorted(c for c in df.columns if fnmatchcase(c, pattern))


def column_catalog(df: DataFrame, pattern: str = "*", name: str = "column_name") -> DataFrame:
    """The same list as a table, with the type of every column."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema if fnmatchcase(f.name, pattern)]
    return df.sparkSession.createDataFrame(rows, f"{name} string, data_type string")


def observable_columns(df: DataFrame, metadata: Iterable[str] = METADATA_COLUMNS) -> list[str]:
    """Everything that is not an id column."""
    skip = set(metadata)
    return [c for c in df.columns if c not in skip]


def bounds_filter(df: DataFrame, generation_lower_bound: int | None = None, time_lower_bound: float | None = None) -> DataFrame:
    """Drop early generations and times; None or 0 keeps everything.

    Both predicates reach the scan: generation as partition pruning, time as a pushed filter.
    """
    if generation_lower_bound and "generation" in df.columns:
        df = df.where(F.col("generation") >= generation_lower_bound)
    if time_lower_bound and "time" in df.columns:
        df = df.where(F.col("time") >= time_lower_bound)
    return df


def load_timeseries(
    df: DataFrame,
    columns: Sequence[str],
    generation_lower_bound: int | None = None,
    time_lower_bound: float | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Requested columns with ids, bounded, in history order."""
    df = bounds_filter(df, generation_lower_bound, time_lower_bound)
    keys = [c for c in METADATA_COLUMNS if c in df.columns]
    df = df.select(*keys, *[c for c in columns if c in df.columns and c not in keys])
    return df.orderBy(*keys) if ordered else df


def order_history(df: DataFrame) -> DataFrame:
    """Global order by the present ones of variant, lineage_seed, generation, time."""
    return df.orderBy(*[c for c in ("variant", "lineage_seed", "generation", "time") if c in df.columns])


def parse_json_arrays(df: DataFrame, *columns: str) -> DataFrame:
    """Turn columns holding JSON array text into ARRAY<DOUBLE>."""
    return df.withColumns({c: F.from_json(F.col(c), "array<double>") for c in columns})


def json_number(column: Column | str, path: str) -> Column:
    """One number out of a JSON document column."""
    return F.get_json_object(column, path).cast("double")
